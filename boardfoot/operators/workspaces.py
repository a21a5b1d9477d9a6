"""Groups, their members and their invitations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from boardfoot.plans.shared import broadcast_if_small, materialize, numbered


def user_groups(memberships: DataFrame, groups: DataFrame) -> DataFrame:
    """Active groups of each user with the role there; the first by name is the default."""
    active = groups.where("is_active = 1").select(F.col("id").alias("group_id"), "name", "slug")
    rank = F.row_number().over(Window.partitionBy("user_id").orderBy("name", "group_id"))
    return memberships.join(active, "group_id").select("user_id", "group_id", "name", "role", (rank == 1).cast("int").alias("is_default"))


def group_roster(memberships: DataFrame, users: DataFrame) -> DataFrame:
    """Members with what is known of the user; a member whose user is missing stays."""
    u = users.select(F.col("id").alias("user_id"), "email", "display_name")
    return memberships.join(u, "user_id", "left").select("group_id", "user_id", "role", "email", "display_name")


def pending_invitations(invitations: DataFrame, groups: DataFrame, now) -> DataFrame:
    """Pending, unexpired invitations to active groups."""
    active = groups.where("is_active = 1").select(F.col("id").alias("group_id"), F.col("name").alias("group_name"), "slug")
    return invitations.where((F.col("status") == "pending") & (F.col("expires_at") > now)).join(active, "group_id").select("id", F.lower("email").alias("email"), "group_id", "group_name", "slug")


def invitations_newest(invitations: DataFrame, when: str) -> DataFrame:
    """A group's invitations numbered from 1, newest first by `when`, ties by larger id."""
    return invitations.withColumn("place", F.row_number().over(Window.partitionBy("group_id").orderBy(F.desc(when), F.desc("id"))))


def expire_invitations(invitations: DataFrame, now) -> DataFrame:
    """Invitations with the pending ones past their time marked so."""
    late = (F.col("status") == "pending") & (F.col("expires_at") < now)
    return invitations.withColumn("status", F.when(late, "expired").otherwise(F.col("status")))


def token_hash(token):
    return F.sha2(token, 256)


def resolve_invitations(asked: DataFrame, invitations: DataFrame, users: DataFrame, memberships: DataFrame, now) -> DataFrame:
    """For each (token, user_id): what comes of it. `invitations` hold token_hash; letter case of e-mails does not count."""
    a = asked.withColumn("token_hash", token_hash(F.col("token")))
    i = invitations.select("token_hash", F.col("id").alias("invitation_id"), "group_id", F.lower("email").alias("invited"), "status", "expires_at")
    u = users.select(F.col("id").alias("user_id"), F.lower("email").alias("own"))
    m = memberships.select("group_id", "user_id", F.lit(1).alias("member"))
    j = a.join(i, "token_hash", "left").join(u, "user_id", "left").join(m, ["group_id", "user_id"], "left")
    outcome = F.when(F.col("invitation_id").isNull(), "unknown").when(F.col("status") != "pending", F.col("status")).when(F.col("expires_at") < now, "expired")
    outcome = outcome.when(~F.col("own").eqNullSafe(F.col("invited")), "wrong user").when(F.col("member") == 1, "member").otherwise("joined")
    return j.select("token", "user_id", outcome.alias("outcome"), F.when(outcome == "joined", F.col("group_id")).alias("group_id"))


def invite_conflicts(wanted: DataFrame, memberships: DataFrame, users: DataFrame, invitations: DataFrame) -> DataFrame:
    """Wanted invitations (group_id, email) with why not: the address is a member's, or has one pending."""
    w = wanted.select("group_id", F.lower("email").alias("email"))
    members = memberships.join(users.select(F.col("id").alias("user_id"), F.lower("email").alias("email")), "user_id").select("group_id", "email").distinct().withColumn("member", F.lit(1))
    pending = invitations.where("status = 'pending'").select("group_id", F.lower("email").alias("email")).distinct().withColumn("pending", F.lit(1))
    j = w.join(members, ["group_id", "email"], "left").join(pending, ["group_id", "email"], "left")
    return j.select("group_id", "email", F.when(F.col("member") == 1, "member").when(F.col("pending") == 1, "pending").otherwise("ok").alias("verdict"))


def group_overview(groups: DataFrame, **facts: DataFrame) -> DataFrame:
    """Per group the number of rows of each fact table named; each fact is counted by itself before it is joined."""
    out = groups.select("id", "name")
    for name, fact in facts.items():
        counts = fact.groupBy(F.col("group_id").alias("id")).agg(F.count("*").alias(name))
        out = out.join(counts, "id", "left").withColumn(name, F.coalesce(name, F.lit(0)))
    return out


def top_members(memberships: DataFrame, fact: DataFrame, n: int = 10) -> DataFrame:
    """The `n` members of each group with the most rows of `fact` there, none included."""
    counts = fact.groupBy("group_id", "user_id").agg(F.count("*").alias("n"))
    j = memberships.select("group_id", "user_id").join(counts, ["group_id", "user_id"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    rank = F.row_number().over(Window.partitionBy("group_id").orderBy(F.desc("n"), "user_id"))
    return j.withColumn("rank", rank).where(F.col("rank") <= n)


#: Up to so many new workspaces (some 20 bytes each) are broadcast to the facts they own; beyond, Spark shuffles those facts.
SMALL = 200_000
# How a workspace made for a user is named and described.
WORKSPACE, DESCRIPTION = "'s Workspace", "Auto-created personal workspace"


def email_slug(email: Column) -> Column:
    """The part of an address before @ in small letters, all but a-z and 0-9 as single dashes; 'workspace' if nothing is left."""
    s = F.regexp_replace(F.lower(F.regexp_extract(email, "^[^@]*", 0)), "[^a-z0-9]+", "-")
    return F.coalesce(F.nullif(F.regexp_replace(s, "^-+|-+$", ""), F.lit("")), F.lit("workspace"))


def unique_slugs(wanted: DataFrame, taken: DataFrame, key: str = "id", base: str = "base") -> DataFrame:
    """(key, slug): for each row of `wanted` (key, base) a slug of its own that is not in `taken` (slug).

    All ask for their base; of those that ask for one slug the smallest key gets it, if it is free. The others go on to
    base-key, then base-key-2, base-key-3, ... Who asks and what is taken meet in joins on the slug, so a base that very many
    share costs no task more than its share; nearly all are served in the first two rounds.
    """
    asking, served, k = materialize(wanted.select(key, base), "asking"), [], 0
    taken = taken.select("slug").where("slug is not null").distinct()
    while not asking.isEmpty():
        slug = F.concat_ws("-", *[F.col(base), F.col(key).cast("string"), F.lit(str(k))][: 1 + min(k, 2)])
        asked = asking.withColumn("slug", slug)
        first = asked.groupBy("slug").agg(F.min(key).alias(key)).join(taken, "slug", "left_anti")
        got = materialize(first.select(key, "slug"), "slugs")
        served.append(got)
        taken = taken.unionByName(got.select("slug"))
        asking = materialize(asking.join(got.select(key), key, "left_anti"), "asking")
        k += 1
    out = served[0] if served else wanted.select(key, F.col(base).alias("slug"))
    for more in served[1:]:
        out = out.unionByName(more)
    return out


def backfill_groups(users: DataFrame, memberships: DataFrame, groups: DataFrame) -> DataFrame:
    """New workspaces (group_id, user_id, name, description, slug) for the users (id, email, display_name) that are in none.

    Ids follow the largest there is, in the order of users' ids, without a task that sees all of them; slugs are unique.
    """
    alone = users.join(memberships.select(F.col("user_id").alias("id")).distinct(), "id", "left_anti").select("id", "email", "display_name")
    top = groups.agg(F.coalesce(F.max("id"), F.lit(0))).first()[0]
    placed = materialize(numbered(alone, ["id"], "group_id", top + 1), "workspaces")
    slugs = unique_slugs(placed.select("id", email_slug(F.col("email")).alias("base")), groups)
    name = F.concat(F.coalesce(F.nullif("display_name", F.lit("")), F.regexp_extract("email", "^[^@]*", 0)), F.lit(WORKSPACE))
    return placed.join(slugs, "id").select("group_id", F.col("id").alias("user_id"), name.alias("name"), F.lit(DESCRIPTION).alias("description"), "slug")


def backfill(users: DataFrame, memberships: DataFrame, groups: DataFrame, uploads: DataFrame, products: DataFrame, mills: DataFrame, activity: DataFrame, searches: DataFrame) -> dict[str, DataFrame]:
    """All tables after each user without a workspace has got one, by name, with `assigned` (group_id, user_id, ...).

    The user owns it, and what of theirs was in no group comes into it: uploads, the products of their uploads, activity and
    searches. Mills in no group come into the first such user's. Rows that have a group, nearly all, are neither shuffled nor joined.
    """
    assigned = materialize(backfill_groups(users, memberships, groups), "assigned")
    owner = broadcast_if_small(assigned.select("user_id", F.col("group_id").alias("new_group")), SMALL)

    def take(fact: DataFrame, own: DataFrame, key: str) -> DataFrame:
        """`fact` with the group of `own` (key, new_group) where it has none."""
        lost = fact.where("group_id is null").join(own, key, "left").withColumn("group_id", F.col("new_group").cast(fact.schema["group_id"].dataType))
        return fact.where("group_id is not null").unionByName(lost.select(*[F.col(c) for c in fact.columns]))

    by_upload = uploads.select(F.col("id").alias("upload_id"), "user_id").join(owner, "user_id").select("upload_id", "new_group")
    first = assigned.agg(F.min_by("group_id", "user_id").alias("g")).first()["g"]
    fill = lambda name, frame: frame.select(*[F.coalesce(F.col(name), F.lit(first).cast(frame.schema[name].dataType)).alias(name) if c == name else F.col(c) for c in frame.columns])
    made = assigned.select(F.col("group_id").alias("id"), "name", "description", "slug", F.col("user_id").alias("created_by"), F.lit(1).alias("is_active"))
    role = assigned.select("group_id", "user_id", F.lit("owner").alias("role"))
    return {
        "assigned": assigned,
        "groups": groups.unionByName(made.select(*[c for c in made.columns if c in groups.columns]), allowMissingColumns=True),
        "memberships": memberships.unionByName(role, allowMissingColumns=True),
        "uploads": take(uploads, owner, "user_id"),
        "products": take(products, by_upload, "upload_id"),
        "mills": fill("group_id", mills) if first is not None else mills,
        "activity": take(activity, owner, "user_id"),
        "searches": take(searches, owner, "user_id"),
    }
