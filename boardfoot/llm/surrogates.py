"""Replace personal data and secrets in text by keyed surrogates of the same kind (DataFrame functions only).

A text is cut into pieces: what stands between mentions, and the mentions' entities. A person's title, initials and
particles ('van', 'de') are kept and each of the names is an entity of its own, so 'Mrs Ana Gold' and 'Mr GOLD' share a
surname before and after. A full name that stands without a title is replaced too where the same text has it with one;
a first name or surname alone, without a title, is not, since many are common words. An entity's surrogate is a function of a secret key, the kind, the entity's canonical value and an attempt, so all mentions of an
entity, in any document, get the same replacement (coreference). Digits stay digits, letters stay letters of their case
and script, punctuation and the prefixes of keys stay in place (format); first names stay feminine or masculine. The
scripts are those of SCRIPTS; letters of others become Latin ones. E-mails lead to example.org and addresses into ranges
that no host on the internet has (10/8, 240/4, fd00::/8).

Collision checks: surrogates of all distinct entities of the corpus are compared with each other and with the entities
themselves; those that clash go to their next attempt until every surrogate is distinct and no entity's own value is in use.
A format can have fewer values than entities, so after a few attempts a surrogate grows by a keyed tail, longer with
each attempt. Only mentions are shuffled for that; a text meets the attempts of its entities by a broadcast of the few
rows that have any, and only beyond `small` of those rows are texts with a hint of an entity shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from boardfoot.plans.shared import materialize

# Titles of persons, and what each kind of entity looks like, in the order in which they are tried at a place.
WOMAN = "Mrs|MRS|Ms|MS|Miss|MISS|Frau|Madame|Mme|Señora|Sra|Госпожа|Κυρία"
MAN = "Mr|MR|Herr|Monsieur|Señor|Sr|Господин|Κύριος"
EITHER = "Dr|DR|Prof|PROF"
TITLE = rf"(?:(?:{WOMAN}|{MAN}|{EITHER})(?:\. ?| )){{1,3}}"
#: A name can hold hyphens and apostrophes (Jean-Luc, O'Brien); before a name can stand particles and initials.
NAME = r"(?:\p{Lu}['’])?\p{Lu}[\p{L}\p{M}]{1,20}(?:-[\p{L}\p{M}]{2,20}|['’]\p{Lu}[\p{L}\p{M}]{1,20}){0,3}"
PARTICLES = r"(?:(?:van|von|de|der|den|del|della|di|da|dos|du|la|le|bin|ibn|al|el|ten|ter|zu|\p{Lu}\.) ){0,3}"
#: Two names or more in a row, as a person is named without a title.
BARE = rf"(?<![\p{{L}}\p{{N}}]){NAME}(?: {PARTICLES}{NAME})+(?![\p{{L}}\p{{N}}])"
KEY_HEAD = r"sk-(?:proj|svcacct|admin|ant|or)-|sk-|[sr]k_(?:live|test)_|gh[pousr]_|github_pat_|glpat-|xox[a-z]-|AKIA|ASIA|AIza|eyJ"
HEX4 = "[0-9a-fA-F]{1,4}"
PATTERNS = {
    "email": r"(?<![\p{L}\p{N}._%+\-])[\p{L}\p{N}._%+\-]{1,64}@[\p{L}\p{N}\-]{1,63}(?:\.[\p{L}\p{N}\-]{1,63})*\.\p{L}{2,24}",
    "key": r"(?<![\p{L}\p{N}])(?:sk-(?:proj|svcacct|admin|ant|or)-[A-Za-z0-9_\-]{20,}|sk-[A-Za-z0-9]{16,}|[sr]k_(?:live|test)_[A-Za-z0-9]{16,}|gh[pousr]_[A-Za-z0-9]{20,}|github_pat_[A-Za-z0-9_]{20,}|glpat-[A-Za-z0-9_\-]{20,}|xox[a-z]-[A-Za-z0-9\-]{20,}|A[KS]IA[0-9A-Z]{16}|AIza[A-Za-z0-9_\-]{35}|eyJ[A-Za-z0-9_\-]{8,}\.[A-Za-z0-9_\-]{8,}\.[A-Za-z0-9_\-]{8,})(?![\p{L}\p{N}])",
    "hex": r"(?<![\p{L}\p{N}])(?:[0-9a-f]{32,}|[0-9A-F]{32,})(?![\p{L}\p{N}])",
    "ip": r"(?<![\p{L}\p{N}.])(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?![\p{L}\p{N}]|\.\d)",
    "ip6": rf"(?<![\p{{L}}\p{{N}}:])(?:(?:{HEX4}:){{7}}{HEX4}|[0-9a-fA-F]{{4}}(?::{HEX4}){{1,5}}:(?::{HEX4}){{1,5}}|(?=[0-9a-fA-F:]*\d)(?:[23][0-9a-fA-F]{{3}}|[fF][c-eC-E][0-9a-fA-F]{{2}}):(?::{HEX4}){{1,6}})(?![\p{{L}}\p{{N}}:])",
    "ssn": r"(?<![\p{L}\p{N}\-])\d{3}-\d{2}-\d{4}(?![\p{L}\p{N}\-])",
    "card": r"(?<![\p{L}\p{N}])(?:\d{13,19}|\d{4}(?:[ \-]\d{4}){3})(?![\p{L}\p{N}])",
    "phone": r"(?<![\p{L}\p{N}+])(?:\+\d{1,3}[ .\-]?)?(?:\(\d{2,4}\)[ .\-]?|\d{2,4}[ .\-])\d{3}[ .\-]\d{4}(?![\p{L}\p{N}])|(?<![\p{L}\p{N}+])\+\d{8,15}(?![\p{L}\p{N}])",
    "iban": r"(?<![\p{L}\p{N}])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![\p{L}\p{N}])",
    "person": rf"(?<![\p{{L}}\p{{N}}]){TITLE}{PARTICLES}{NAME}(?: {PARTICLES}(?!{TITLE}{PARTICLES}{NAME}){NAME})?(?![\p{{L}}\p{{N}}])",
}
#: Kinds of a person's names; they share one space of values.
NAMES = ("woman", "man", "first", "surname")
#: Kinds in which punctuation does not count.
NUMBERS = ("phone", "card", "ssn", "iban")
# Letters of which surrogates are made by script (odd places, even places), and endings that mark a
# surrogate first name's gender.
SCRIPTS = {
    "Cyrillic": ("бвгдклмнпрст", "аеиоу"),
    "Greek": ("βγδζκλμνπρστ", "αεηιου"),
    "Arabic": ("بتجدرسفكلمن", "اوي"),
    "Hebrew": ("בגדהזחטלמנפקרשת", "אוי"),
    "Devanagari": ("कगचजतदनपबमरलवस", "कगचजतदनपबमरलवस"),
    "Hangul": ("가나다라마바사아자하", "고노도로모보소오조호"),
    "Hiragana": ("かきくさしすたつてなにの", "はひふまみむらりるわ"),
    "Katakana": ("カキクサシスタツテナニノ", "ハヒフマミムラリルワ"),
    "Han": ("安白長大東方光海和花", "江金里林明木平山田文"),
}
LATIN = ("bdfgklmnprstvz", "aeiou")
ENDINGS = {"woman": {"Cyrillic": "а", "Greek": "α"}, "man": {"Cyrillic": "н", "Greek": "ος"}}
LATIN_ENDINGS = {"woman": "a", "man": "o"}
LETTERS, HEX = "abcdefghijklmnopqrstuvwxyz", "0123456789abcdef"
#: Attempts that keep an entity's length; an address is in the private network 10 for two attempts, then in the reserved
#: 240/4, and from attempt KEPT on eight groups of the unique local fd00::/8.
KEPT = 6
ANY = "|".join(f"(?:{p})" for p in PATTERNS.values())
TITLES = f"{WOMAN}|{MAN}|{EITHER}".split("|")
#: What every entity has some of: fixed strings, then patterns; each pattern begins with few signs, so that a text is passed over quickly.
MARKS = ("@", "sk-", "k_live_", "k_test_", "ghp_", "gho_", "ghu_", "ghs_", "ghr_", "github_pat_", "glpat-", "xox", "AKIA", "ASIA", "AIza", "eyJ")
HINTS = (
    r"\d[\d.() \-]{6}",
    rf"[{''.join(sorted({t[0] for t in TITLES}))}](?:{'|'.join(sorted({t[1:] for t in TITLES}))})(?:\. ?| )[\p{{Lu}}vdlbiaetz]",
    r"[A-Z]{2}\d\d", r":[0-9a-fA-F]{0,4}:[0-9a-fA-F]", r"[0-9a-fA-F]{32}",
)
PIECES = "array<struct<text:string,kind:string>>"


def hint(text: Column) -> Column:
    """A cheap look at a text before the full pattern: no text with an entity fails it. False for null."""
    found = F.lit(False)
    for mark in MARKS:
        found = found | F.contains(text, F.lit(mark))
    for pattern in HINTS:
        found = found | text.rlike(pattern)
    return F.coalesce(found, F.lit(False))


def kind_of(entity: Column) -> Column:
    """The first kind whose pattern is the whole of `entity`."""
    return F.coalesce(*[F.when(entity.rlike(f"^(?:{p})$"), F.lit(k)) for k, p in PATTERNS.items()])


def _words(words: Column, first: Column) -> Column:
    """(text, kind) of a person's words: the last is the surname and the names before it have the kind `first`; others have none."""
    last = F.size(words) - 1
    name = lambda w: w.rlike(f"^{NAME}$")
    return F.transform(words, lambda w, i: F.struct(w.alias("text"), F.when(i == last, F.lit("surname")).when(name(w), first).alias("kind")))


def _gender(title: Column) -> Column:
    return F.when(title.rlike(f"^(?:{WOMAN})[. ]"), "woman").when(title.rlike(f"^(?:{MAN})[. ]"), "man").otherwise("first")


def _person(mention: Column) -> Column:
    """(title, words with their kinds) of a person's mention."""
    title = F.regexp_extract(mention, f"^{TITLE}", 0)
    return F.struct(title.alias("title"), _words(F.split(F.substr(mention, F.length(title) + 1), " "), _gender(title)).alias("words"))


def _spaced(words: Column) -> Column:
    """Pieces of words with what stands between them."""
    space = F.struct(F.lit(" ").alias("text"), F.lit(None).cast("string").alias("kind"))
    return F.flatten(F.transform(words, lambda w, i: F.when(i > 0, F.array(space, w)).otherwise(F.array(w))))


def _names(mention: Column) -> Column:
    """The pieces of a person's mention."""
    title = lambda p: F.array(F.struct(p["title"].alias("text"), F.lit(None).cast("string").alias("kind")))
    return F.transform(F.array(_person(mention)), lambda p: F.concat(title(p), _spaced(p["words"])))[0]


def full_names(found: Column) -> Column:
    """From a text's mentions of entities: 'first|second' in small letters -> kinds, for each two words that follow each other in a titled name."""
    persons = F.filter(found, lambda m: m.rlike(f"^{PATTERNS['person']}$"))
    words = F.transform(persons, lambda m: _person(m)["words"])
    entry = lambda a, b: F.struct(F.lower(F.concat_ws("|", a["text"], b["text"])).alias("key"), F.struct(a["kind"].alias("a"), b["kind"].alias("b")).alias("value"))
    pairs = F.flatten(F.transform(words, lambda w: F.zip_with(F.slice(w, 1, F.size(w) - 1), F.slice(w, 2, F.size(w)), entry)))
    first = lambda all_: F.filter(all_, lambda x, i: (i == 0) | (F.get(all_, i - 1)["key"] != x["key"]))
    return F.map_from_entries(F.transform(F.array(F.array_sort(F.array_distinct(pairs))), first)[0])


def bare_pieces(gap: Column, names: Column) -> Column:
    """The pieces of what stands between mentions: full names in `names` that stand without a title, and the rest."""
    keep = lambda t: F.array(F.struct(t.alias("text"), F.lit(None).cast("string").alias("kind")))
    at = lambda w, i: F.try_element_at(names, F.lower(F.concat_ws("|", F.get(w, i), F.get(w, i + 1))))
    kinds = lambda w: F.transform(w, lambda t, i: F.struct(t.alias("text"), F.coalesce(at(w, i)["a"], F.when(i > 0, at(w, i - 1)["b"])).alias("kind")))
    bare = F.transform(F.regexp_extract_all(gap, F.lit(f"({BARE})"), 1), lambda m: _spaced(F.transform(F.array(F.split(m, " ")), kinds)[0]))
    return F.flatten(F.zip_with(F.split(gap, BARE, -1), bare, lambda g, b: F.concat(keep(g), F.coalesce(b, F.array().cast(PIECES)))))


def entity_pieces(text: Column) -> Column:
    """For each mention of a text, in order, its pieces (text, kind); kind is null for what is kept."""
    return _mention_pieces(F.regexp_extract_all(text, F.lit(f"({ANY})"), 1))


def _mention_pieces(found: Column) -> Column:
    kinds = F.transform(found, lambda m: F.struct(m.alias("text"), kind_of(m).alias("kind")))
    return F.transform(kinds, lambda x: F.when(x["kind"] == "person", _names(x["text"])).otherwise(F.array(F.struct(x["text"].alias("text"), x["kind"].alias("kind")))).cast(PIECES))


def canonical(kind: Column, entity: Column) -> Column:
    """What identifies an entity: letter case does not count in a name, an e-mail, an address or a hexadecimal secret, nor punctuation in a number."""
    return F.when(kind.isin("email", "hex", "ip6", *NAMES), F.lower(entity)).when(kind.isin(*NUMBERS), F.upper(F.regexp_replace(entity, r"[^\p{L}\p{N}]", ""))).otherwise(entity)


def _number(bits: Column, i: Column) -> Column:
    """The i-th pseudo-random number below 65536, i from 0."""
    return F.conv(F.substr(bits, (i * 4 + 1).cast("int"), F.lit(4)), 16, 10).cast("int")


def _pick(alphabet: str | Column, n: Column) -> Column:
    size = len(alphabet) if isinstance(alphabet, str) else F.length(alphabet)
    return F.substr(F.lit(alphabet), (n % size + 1).cast("int"), F.lit(1))


def _script(text: Column) -> Column:
    """The first of SCRIPTS of which `text` has a letter; null for others, the Latin script among them."""
    named = F.coalesce(*[F.when(text.rlike(rf"\p{{Is{s}}}"), F.lit(s)) for s in SCRIPTS])
    return F.when(text.rlike(r"[^\x00-\x7F]"), named)


def _of_script(script: Column, table: dict, otherwise) -> Column:
    """The value of `table` for a script."""
    out = F.when(script.isNull(), F.lit(otherwise))
    for name, value in table.items():
        out = out.when(script == name, F.lit(value))
    return out.otherwise("")


def _exchange(kind: Column, c: Column, n: Column, i: Column) -> Column:
    """A sign of the kind, case and script of `c`, chosen by the number `n`; other signs than letters and digits stay."""
    small = F.lower(c)
    plain = small.between("a", "z")
    letters = F.when(i % 2 == 0, _of_script(_script(c), {s: x[0] for s, x in SCRIPTS.items()}, LATIN[0])).otherwise(_of_script(_script(c), {s: x[1] for s, x in SCRIPTS.items()}, LATIN[1]))
    letters = F.when(kind.isin("hex", "ip6"), HEX).when(kind.isin("key", "iban") & plain, LETTERS).otherwise(letters)
    letter = _pick(letters, n)
    letter = F.when(c == small, letter).otherwise(F.upper(letter))
    digit = F.when(kind.isin("hex", "ip6"), _pick(HEX, n)).otherwise((n % 10).cast("string"))
    return F.when(c.between("0", "9"), digit).when(plain | c.rlike(r"^\p{L}$"), letter).when(c.rlike(r"^\p{N}$"), (n % 10).cast("string")).otherwise(c)


def _upper_hex(text: Column, new: Column) -> Column:
    """Hexadecimal digits that came for digits take the case of the text's letters."""
    return F.when(text.rlike("[A-F]") & ~text.rlike("[a-f]"), F.upper(new)).otherwise(F.lower(new))


def surrogates(pieces: Column, key: str, attempt) -> Column:
    """The replacements of pieces (text, kind), in order. `attempt` gives a column from a piece's kind and canonical value.

    Each step is an array of its own, so no part of an expression stands in it more often than it is asked for.
    """
    named = F.transform(pieces, lambda p: F.struct(p["text"].alias("text"), p["kind"].alias("kind"), F.when(p["kind"].isNotNull(), canonical(p["kind"], p["text"])).alias("value")))
    tried = F.transform(named, lambda p: F.struct(p["text"].alias("text"), p["kind"].alias("kind"), p["value"].alias("value"), F.when(p["kind"].isNotNull(), attempt(p["kind"], p["value"])).alias("attempt")))

    def bits(p: Column) -> Column:
        """Pseudo-random hexadecimal digits: four for each sign, the tail and some to spare; a hash for every 16 numbers."""
        seed = F.concat_ws("|", F.lit(key), p["kind"], p["value"], p["attempt"].cast("string"))
        last = F.floor((F.length(p["text"]) + 2 * p["attempt"] + 16) / 16)
        return F.array_join(F.transform(F.sequence(F.lit(0).cast("long"), last), lambda b: F.sha2(F.concat_ws("|", seed, b.cast("string")), 256)), "")

    keyed = F.transform(tried, lambda p: F.struct(p["text"].alias("text"), p["kind"].alias("kind"), p["attempt"].alias("attempt"), F.when(p["kind"].isNotNull(), bits(p)).alias("bits")))
    return F.transform(keyed, lambda p: F.when(p["kind"].isNull(), p["text"]).otherwise(_surrogate(p["kind"], p["text"], p["attempt"], p["bits"])))


def _surrogate(kind: Column, text: Column, attempt: Column, bits: Column) -> Column:
    body = F.when(kind == "email", F.regexp_extract(text, "^[^@]*", 0)).otherwise(text)
    kept = F.when(kind == "key", F.length(F.regexp_extract(text, f"^(?:{KEY_HEAD})", 0))).when(kind == "iban", 2).when((kind == "phone") & F.startswith(text, F.lit("+")), 2).otherwise(0)
    # In a number the i-th digit takes the i-th number, whatever stands between.
    place = lambda i: F.when(kind.isin(*NUMBERS), F.length(F.regexp_replace(F.substr(text, F.lit(1), i), r"[^\p{L}\p{N}]", ""))).otherwise(i)
    new = F.array_join(F.transform(F.split(body, ""), lambda c, i: F.when(i < kept, c).otherwise(_exchange(kind, c, _number(bits, place(i)), i))), "")
    longer = F.greatest(attempt - (KEPT - 1), F.lit(0))
    made = F.array(F.struct(new.alias("new"), longer.alias("longer"), F.when(kind.isin(*NAMES), _script(text)).alias("script")))
    return F.transform(made, lambda m: _finished(kind, text, attempt, bits, m["new"], m["longer"], m["script"]))[0]


def _finished(kind: Column, text: Column, attempt: Column, bits: Column, new: Column, longer: Column, script: Column) -> Column:
    """The surrogate from `new`, the signs exchanged one by one: its tail of the length `longer`, ending, network or domain."""
    # Numbers from the end of `bits` make what is not exchanged sign by sign.
    spare = lambda i: _number(bits, (F.length(text) + i).cast("int"))
    many = F.when(longer > 0, F.sequence(F.lit(1), longer)).otherwise(F.array().cast("array<int>"))
    each = lambda one: F.array_join(F.transform(many, one), "")
    letters = [_of_script(script, {s: x[k] for s, x in SCRIPTS.items()}, LATIN[k]) for k in (0, 1)]
    tail = F.when(kind.isin(*NAMES), each(lambda i: F.concat(_pick(letters[0], spare(2 * i)), _pick(letters[1], spare(2 * i + 1)))))
    tail = tail.when(kind.isin("email", "hex", "key"), each(lambda i: _pick(HEX, spare(i)))).otherwise(each(lambda i: (spare(i) % 10).cast("string")))
    ending = F.lit("")
    for who, by_script in ENDINGS.items():
        ending = F.when(kind == who, _of_script(script, by_script, LATIN_ENDINGS[who])).otherwise(ending)
    octet = lambda i: (_number(bits, F.lit(i)) % 254 + 1).cast("string")
    network = F.when(attempt < 2, F.lit("10")).otherwise((_number(bits, F.lit(3)) % 15 + 240).cast("string"))
    local = F.concat(F.lit("fd"), F.substr(bits, F.lit(3), F.lit(2)), F.regexp_replace(F.substr(bits, F.lit(5), F.lit(28)), "(.{4})", ":$1"))
    address = F.when(longer > 0, local).when(kind == "ip", F.concat_ws(".", network, octet(0), octet(1), octet(2)))
    address = address.otherwise(_upper_hex(text, F.concat(F.lit("fd"), F.substr(bits, F.lit(1), F.lit(2)), F.regexp_extract(new, "^[^:]*(.*)$", 1))))
    out = F.when(kind == "email", F.concat(F.lower(new), tail, F.lit("."), F.substr(bits, F.length(bits) - 7, F.lit(8)), F.lit("@example.org")))
    out = out.when(kind.isin("ip", "ip6"), address).when(kind == "hex", _upper_hex(text, F.concat(new, tail)))
    out = out.otherwise(F.concat(new, tail, ending))
    capitals = kind.isin("email", "key", *NAMES) & (text == F.upper(text)) & (text != F.lower(text))
    return F.transform(F.array(out), lambda o: F.when(capitals, F.upper(o)).otherwise(o))[0]


def mentions(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(row, kind, entity): every entity that a text mentions; row is a hash of the text."""
    text = F.col(f"`{text_col}`")
    found = docs.where(hint(text)).select(F.xxhash64(text).alias("row"), F.explode(F.flatten(entity_pieces(text))).alias("p"))
    return found.where("p.kind is not null").select("row", F.col("p.kind").alias("kind"), F.col("p.text").alias("entity"))


def clashes(entities: DataFrame, key: str, most: int = 60) -> DataFrame:
    """(kind, canonical, attempt): the entities that need an attempt other than 0, from (kind, entity).

    In a round each waiting entity has a surrogate. It is settled unless an entity of the corpus or a settled surrogate
    has that value; of several with one value the smallest entity is. The others wait for the next round, whose
    surrogates are other ones, and longer ones from attempt KEPT on. Names of all kinds share one space of values.
    """
    named = entities.withColumn("canonical", canonical(F.col("kind"), F.col("entity"))).groupBy("kind", "canonical").agg(F.min("entity").alias("entity"))
    space = lambda kind: F.when(kind.isin(*NAMES), "name").when(kind == "ip6", "ip").otherwise(kind).alias("space")
    real = named.select(space(F.col("kind")), F.col("canonical").alias("value"), F.lit(None).cast("string").alias("owner"))
    waiting, taken, moved = named, real, None
    new = surrogates(F.array(F.struct(F.col("entity").alias("text"), "kind")), key, lambda kind, value: F.col("attempt"))[0]
    for attempt in range(most):
        made = waiting.withColumn("attempt", F.lit(attempt)).withColumn("new", new)
        made = materialize(made.select("kind", "canonical", "entity", space(F.col("kind")), canonical(F.col("kind"), F.col("new")).alias("value")), "surrogates")
        asks = made.select("space", "value", F.concat_ws("|", "kind", "canonical").alias("owner"))
        owner = taken.unionByName(asks).groupBy("space", "value").agg(F.min("owner").alias("owner"), F.count("*").alias("n"), F.count("owner").alias("k"))
        lost = owner.where("n > 1").select("space", "value", F.when(F.col("n") == F.col("k"), F.col("owner")).alias("owner"))
        mine = F.concat_ws("|", "kind", "canonical")
        made = made.join(lost.withColumn("shared", F.lit(True)), ["space", "value"], "left")
        made = materialize(made.select("kind", "canonical", "entity", "space", "value", (F.col("shared").isNull() | F.coalesce(F.col("owner") == mine, F.lit(False))).alias("settled")), "settled")
        waiting = made.where(~F.col("settled")).select("kind", "canonical", "entity")
        if attempt:
            later = made.where("settled").select("kind", "canonical", F.lit(attempt).alias("attempt"))
            moved = later if moved is None else moved.unionByName(later)
        if waiting.isEmpty():
            return moved if moved is not None else waiting.select("kind", "canonical", F.lit(0).alias("attempt"))
        taken = taken.unionByName(made.where("settled").select("space", "value", F.lit(None).cast("string").alias("owner")))
    raise RuntimeError(f"surrogates still clash after {most} attempts")


def replace_pii(docs: DataFrame, key: str, id_col: str = "doc_id", text_col: str = "text", small: int = 200_000) -> DataFrame:
    """`docs` with surrogates in `text_col` and a column n_entities (int): mentions replaced.

    Null stays null and an empty text empty, each with 0 entities; a text without entities is returned as it is. Repeated
    rows get the same text. An empty table gives an empty one. Other columns are kept whatever their names, but for one
    named n_entities, which is replaced. The attempts of up to `small` rows are broadcast.
    """
    name = lambda c: F.col("`" + c.replace("`", "``") + "`")
    docs = docs.drop("n_entities")
    found = materialize(mentions(docs, text_col), "mentions")
    moved = clashes(found.select("kind", "entity").distinct(), key)
    text = name(text_col)
    some = hint(text)
    if moved.isEmpty():
        return _rewritten(docs, docs.columns, text_col, some, key, lambda kind, value: F.lit(0), name)
    column, row = "moved", "row"
    while {column, row} & {c.lower() for c in docs.columns}:
        column, row = f"_{column}", f"_{row}"
    # An entity of a very common text is one row a text.
    by_text = found.distinct().withColumn("canonical", canonical(F.col("kind"), F.col("entity"))).join(moved, ["kind", "canonical"])
    by_text = by_text.select(F.col("row").alias(row), F.concat_ws("|", "kind", "canonical").alias("k"), "attempt").distinct()
    by_text = materialize(by_text.groupBy(row).agg(F.map_from_entries(F.collect_list(F.struct("k", "attempt"))).alias(column)), "attempts")
    attempt = lambda kind, value: F.coalesce(F.try_element_at(F.col(column), F.concat_ws("|", kind, value)), F.lit(0))
    if by_text.limit(small + 1).count() <= small:
        rows = docs.withColumn(row, F.xxhash64(text)).join(F.broadcast(by_text), row, "left")
        return _rewritten(rows, docs.columns, text_col, some, key, attempt, name)
    hinted = docs.where(some).withColumn(row, F.xxhash64(text)).join(by_text, row, "left")
    rest = docs.where(~some).select("*", F.lit(0).alias("n_entities"))
    return _rewritten(hinted, docs.columns, text_col, some, key, attempt, name).unionByName(rest)


def _rewritten(rows: DataFrame, columns: list[str], text_col: str, some: Column, key: str, attempt, name) -> DataFrame:
    """`rows` with the texts that `some` marks rewritten, and n_entities."""
    text = name(text_col)
    gaps, mentioned = F.split(text, ANY, -1), F.regexp_extract_all(text, F.lit(f"({ANY})"), 1)
    kept = lambda g: F.array(F.struct(g.alias("text"), F.lit(None).cast("string").alias("kind"))).cast(PIECES)
    between = lambda n: F.transform(gaps, lambda g: F.when(F.size(n) > 0, bare_pieces(g, n)).otherwise(kept(g)))
    cut = F.transform(F.array(mentioned), lambda m: F.struct(_mention_pieces(m).alias("found"), full_names(m).alias("names")))[0]
    cut = F.transform(F.array(cut), lambda c: F.struct(between(c["names"]).alias("between"), c["found"].alias("found")))[0]
    cut = F.when(some, F.transform(F.array(cut), lambda c: F.struct(
        F.flatten(F.zip_with(c["between"], c["found"], lambda g, p: F.concat(g, F.coalesce(p, F.array().cast(PIECES))))).alias("pieces"),
        # A full name without a title has one surname.
        (F.size(c["found"]) + F.size(F.filter(F.flatten(c["between"]), lambda p: p["kind"] == "surname"))).alias("n"),
    ))[0])
    column = "cut"
    while column in {c.lower() for c in rows.columns}:
        column = f"_{column}"
    rows = rows.withColumn(column, cut)
    some = F.coalesce(F.col(column)["n"] > 0, F.lit(False))
    changed = F.when(some, F.array_join(surrogates(F.col(column)["pieces"], key, attempt), "")).otherwise(text).alias(text_col)
    count = F.when(some, F.col(column)["n"]).otherwise(0).cast("int").alias("n_entities")
    return rows.select(*[changed if c == text_col else name(c) for c in columns], count)
