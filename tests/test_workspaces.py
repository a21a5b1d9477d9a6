"""Workspaces for users without one, and mills' numbers, without a task that sees all rows."""

from boardfoot.operators import catalog, workspaces


def one_task(df) -> bool:
    plan = df._jdf.queryExecution().executedPlan().toString()
    return "SinglePartition" in plan or "Window" in plan


def test_slugs_are_unique(spark):
    """Taken names, names that others ask for, names that the number of a user completes, and addresses without letters."""
    emails = {1: "Joe@a.com", 2: "joe@b.com", 3: "joe-2@c.com", 4: "First.Last@x.com", 5: "first_last@y.com", 6: "--@z.com", 7: "@z.com", 8: "JOE.2@d.com"}
    users = spark.createDataFrame([(i, e, None) for i, e in emails.items()] + [(9, "in@x.com", "In")], "id long, email string, display_name string")
    groups = spark.createDataFrame([(40, "Joe", "joe"), (41, "x", "joe-1"), (42, "y", None)], "id long, name string, slug string")
    members = spark.createDataFrame([(40, 9, "owner")], "group_id long, user_id long, role string")
    made = workspaces.backfill_groups(users, members, groups)
    got = {r["user_id"]: (r["group_id"], r["slug"], r["name"]) for r in made.collect()}
    assert {i: g for i, (g, _, _) in got.items()} == {i: 42 + i for i in emails}
    assert {i: s for i, (_, s, _) in got.items()} == {1: "joe-1-2", 2: "joe-2-2", 3: "joe-2", 4: "first-last", 5: "first-last-5", 6: "workspace", 7: "workspace-7", 8: "joe-2-8"}
    assert got[1][2] == "Joe's Workspace" and not one_task(made)


def test_backfill_takes_only_what_has_no_group(spark):
    table = lambda rows, cols: spark.createDataFrame(rows, cols)
    new = workspaces.backfill(
        users=table([(1, "a@x.com", "A"), (2, "b@x.com", ""), (3, "c@x.com", "C")], "id long, email string, display_name string"),
        memberships=table([(7, 3, "member")], "group_id long, user_id long, role string"),
        groups=table([(7, "g", "a")], "id long, name string, slug string"),
        uploads=table([(10, 1, None), (11, 1, 7), (12, 3, None), (13, None, None)], "id long, user_id long, group_id long"),
        products=table([(20, 10, None), (21, 11, None), (22, 12, None), (23, 10, 7)], "id long, upload_id long, group_id long"),
        mills=table([(30, "m", None), (31, "n", 7)], "id long, name string, group_id long"),
        activity=table([(40, 2, None)], "id long, user_id long, group_id long"),
        searches=table([(50, 2, 7)], "id long, user_id long, group_id long"),
    )
    got = {k: {r["id"]: r["group_id"] for r in new[k].collect()} for k in ("uploads", "products", "mills", "activity", "searches")}
    assert got == {"uploads": {10: 8, 11: 7, 12: None, 13: None}, "products": {20: 8, 21: 8, 22: None, 23: 7}, "mills": {30: 8, 31: 7}, "activity": {40: 9}, "searches": {50: 7}}
    assert sorted((r["group_id"], r["user_id"], r["role"]) for r in new["memberships"].collect()) == [(7, 3, "member"), (8, 1, "owner"), (9, 2, "owner")]
    assert sorted((r["id"], r["slug"], r["name"]) for r in new["groups"].collect()) == [(7, "a", "g"), (8, "a-1", "A's Workspace"), (9, "b", "b's Workspace")]


def test_nobody_without_a_workspace(spark):
    users = spark.createDataFrame([(3, "c@x.com", "C")], "id long, email string, display_name string")
    members = spark.createDataFrame([(7, 3, "member")], "group_id long, user_id long, role string")
    groups = spark.createDataFrame([(7, "g", "a")], "id long, name string, slug string")
    assert workspaces.backfill_groups(users, members, groups).collect() == []


def test_new_mills_know_their_first_upload(spark):
    mills = spark.createDataFrame([(5, 1, "Oak Co", "old")], "id long, group_id long, name string, phone string")
    seen = [(1, " Oak Co ", 9, "new", "x@y"), (1, "Elm Co", 8, None, "b@y"), (1, "Elm Co ", 3, "p3", None), (2, "Elm Co", 1, "p1", None), (2, "", 1, "z", None), (2, "L" * 120, 2, "p2", None)]
    out = catalog.upsert_mills(mills, spark.createDataFrame(seen, "group_id long, name string, upload_id long, phone string, email string"))
    got = {r["id"]: (r["group_id"], r["name"], r["phone"], r["email"]) for r in out.collect()}
    assert got == {5: (1, "Oak Co", "old", None), 6: (2, "Elm Co", "p1", None), 7: (2, "L" * 100, "p2", None), 8: (1, "Elm Co", "p3", None)}
    assert not one_task(out)
