"""Personal data to surrogates, in DataFrame expressions only.

One regular expression finds e-mail addresses, IPv4 addresses, card numbers, phone numbers, social security numbers and names
behind a title; in a document with such names, every later or earlier mention of their words, capitalized, counts too. Each is replaced by a surrogate drawn from a keyed digest of its type and canonical form, so one entity
has one surrogate everywhere (coreference). Cards, phones and social security numbers have their digits drawn once, from the
canonical digits, and laid into each written form; phones with + count as international, others as national. Surrogates keep type and format: digits stay digits, letters keep their case,
separators stay, card numbers pass the Luhn check where the original does, names keep gender and script.

A corpus-wide collision check makes surrogates distinct: entities whose surrogate another entity has, or that is itself an
entity of the corpus, draw again. Only these few exceptions are joined back to their documents.

The key is the caller's secret: who has it can recompute the surrogates. Draws that keep colliding get longer (more letters or digits),
so the check ends where a format has fewer surrogates than entities. A given name is one entity behind whatever titles it stands: its gender is that of its
gendered titles in the whole corpus, neutral where there are none or both.

Defined results: null text stays null; text without personal data is unchanged; repeated rows and a null doc_id give results each;
other columns are carried through, whatever their names (``counted`` is replaced); an empty table gives no rows. Memory is a small multiple of one text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from talonscan.llm.common import materialize, table

#: Session setting with the key, and the key of the registered queries where it is not set (tests, demonstration).
KEY_SETTING, OPEN_KEY = "spark.talonscan.pii.key", "surrogate-key"
#: Draws after which surrogates get longer.
LONGER = 8

EMAIL = r"(?<![\p{L}\p{N}._%+-])[\p{L}\p{N}._%+-]{1,64}@[\p{L}\p{N}-]{1,63}(?:\.[\p{L}\p{N}-]{1,63}){1,8}"
IP = r"(?<![\d.])(?:\d{1,3}\.){3}\d{1,3}(?!\d|\.\d)"
CARD = r"(?<![\d.+-])\d(?:[ -]?\d){12,18}(?![\d-])"
SSN = r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])"
PHONE = r"(?<![\w+(])(?:\+\d{1,3}[ .-]?)?(?:\(\d{2,4}\)[ .-]?|\d{3}[ .-])\d{3}[ .-]?\d{4}(?!\d)|(?<![\w+])\+\d{1,3}(?:[ .-]?\d{2,4}){2,5}(?!\d)"
#: Titles by gender; a name is one or two capitalized words behind one.
MALE = ["Mr", "Herr", "Señor", "Sr", "Monsieur", "господин", "г-н"]
FEMALE = ["Mrs", "Ms", "Miss", "Frau", "Señora", "Sra", "Madame", "Mme", "госпожа", "г-жа"]
NEUTRAL = ["Dr", "Prof", "Doctor", "Professor", "Doktor", "доктор", "профессор"]
TITLES = [x for t in MALE + FEMALE + NEUTRAL for x in (t, t.upper())]
#: The first letter is looked at before the titles are tried.
NAME = "(?=[" + "".join(sorted({t[0] for t in TITLES})) + r"])(?<![\p{L}])(?:" + "|".join(TITLES) + r")\.?\x20\p{Lu}[\p{L}'-]{1,30}(?:\x20\p{Lu}[\p{L}'-]{1,30})?"
#: Calling code of an international phone's seed; these codes are prefix-free.
COUNTRY = r"^phone:\+(1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|\d{3})"
#: All but mail, which is the costliest to look for; texts without @ are held against these only.
REST = "|".join([IP, CARD, SSN, PHONE, NAME])
ANY = EMAIL + "|" + REST
#: A text that matches neither this nor NAME has no personal data; cheap to test.
GATE = r"\d.{0,3}\d|@"
#: A mention of a name's word.
WORD = r"^[\p{L}'-]+$"

LATIN = ["ba", "ve", "lo", "ri", "mun", "sa", "ke", "dor", "ni", "tal", "pe", "gor", "li", "wan", "zu", "fe"]
CYRILLIC = ["ба", "ве", "ло", "ри", "мун", "са", "ке", "дор", "ни", "тал", "пе", "гор", "ли", "ван", "зу", "фе"]


def kind_of(m: Column) -> Column:
    return (
        F.when(m.contains("@"), "email")
        .when(m.rlike(r"^(?:\d{1,3}\.){3}\d{1,3}$"), "ip")
        .when(m.rlike(WORD), "word")
        .when(m.rlike(r"^\p{L}"), "name")
        .when(m.rlike(r"^\d{3}-\d{2}-\d{4}$"), "ssn")
        .when(m.rlike(r"^\d(?:[ -]?\d){12,18}$"), "card")
        .otherwise("phone")
    )


def digits(m: Column) -> Column:
    return F.regexp_replace(m, r"\D", "")


def number_of(m: Column) -> Column:
    """Canonical form of a number: its digits, behind + where it is written so."""
    return F.concat(F.when(m.startswith("+"), "+").otherwise(""), digits(m))


def luhn_sum(number: Column, doubled: int) -> Column:
    """Luhn sum of a digit string; places counted from the right with parity ``doubled`` count double."""
    places = F.transform(F.split(F.reverse(number), ""), lambda d, i: F.struct(d.cast("int").alias("d"), i.alias("i")))
    value = lambda p: F.when(p["i"] % 2 == doubled, F.floor(p["d"] * 2 / 10).cast("int") + p["d"] * 2 % 10).otherwise(p["d"])
    return F.aggregate(F.filter(places, lambda p: p["d"].isNotNull()), F.lit(0), lambda a, p: a + value(p).cast("int"))


def _draw(key: str, seed: Column, attempt: Column) -> Column:
    return F.sha2(F.concat(F.lit(key + "|"), seed, F.lit("|"), attempt.cast("string")), 256)


def _byte(digest: Column, i) -> Column:
    at = (i if isinstance(i, Column) else F.lit(i)) % 31
    return F.conv(F.substring(digest, at * 2 + 1, F.lit(2)), 16, 10).cast("int")


def same_format(text: Column, digest: Column) -> Column:
    """Every digit and letter replaced by another of its sort; the rest stays."""
    pick = lambda letters, i: F.substring(F.lit(letters), (_byte(digest, i) + i) % len(letters) + 1, F.lit(1))
    low, cyr = "abcdefghijklmnopqrstuvwxyz", "абвгдежзиклмнопрстуфхцчшэюя"
    return F.array_join(
        F.transform(
            F.filter(F.split(text, ""), lambda c: c != ""),
            lambda c, i: F.when(c.rlike(r"\d"), pick("0123456789", i))
            .when(c.rlike(r"\p{IsCyrillic}") & c.rlike(r"\p{Lu}"), pick(cyr.upper(), i))
            .when(c.rlike(r"\p{IsCyrillic}"), pick(cyr, i))
            .when(c.rlike(r"\p{Lu}"), pick(low.upper(), i))
            .when(c.rlike(r"\p{L}"), pick(low, i))
            .otherwise(c),
        ),
        "",
    )


def number_digits(seed: Column, digest: Column, attempt: Column) -> Column:
    """Digits of a number's surrogate, one for each digit of the seed (more in late draws); a country code and the Luhn check stay."""
    old = digits(seed)
    code = F.length(F.regexp_extract(seed, COUNTRY, 1))
    drawn = F.array_join(
        F.transform(
            F.filter(F.split(old, ""), lambda c: c != ""),
            lambda c, i: F.when(i < code, c).otherwise(((_byte(digest, i) + i) % 10).cast("string")),
        ),
        "",
    )
    body = F.substring(drawn, F.lit(1), F.length(drawn) - 1)
    check = (10 - luhn_sum(body, 0) % 10) % 10
    more = F.substring(F.translate(digest, "abcdef", "012345"), F.lit(1), F.floor(attempt / LONGER).cast("int"))
    return F.when(seed.startswith("card:") & (luhn_sum(old, 1) % 10 == 0), F.concat(body, check.cast("string"))).otherwise(F.concat(drawn, more))


def lay(number: Column, shape: Column) -> Column:
    """shape with its digits replaced by those of number in turn; digits left over follow the last one."""
    gaps = F.split(shape, r"\d", -1)
    digit = lambda i: F.when(i == F.size(gaps) - 2, F.substring(number, i + 1, F.length(number))).otherwise(F.substring(number, i + 1, F.lit(1)))
    return F.array_join(F.transform(gaps, lambda gap, i: F.concat(gap, F.when(i < F.size(gaps) - 1, digit(i)).otherwise(""))), "")


def title_of(m: Column) -> Column:
    return F.regexp_extract(m, r"^(\S+) ", 1)


def name_parts(m: Column) -> Column:
    return F.split(F.regexp_replace(m, r"^\S+ ", ""), " ")


def gender_of(m: Column) -> Column:
    title = F.regexp_replace(title_of(m), r"\.$", "")
    among = lambda titles: title.isin([x for t in titles for x in (t, t.upper())])
    return F.when(among(MALE), "m").when(among(FEMALE), "f").otherwise("n")


def _name(part: Column, gender: Column, digest: Column, attempt: Column) -> Column:
    """A made-up word of the part's script and case; given names end by gender. Later draws get more syllables."""

    def word(syllables, endings):
        count = F.lit(3) + F.least(attempt, F.lit(20))
        body = F.array_join(F.transform(F.sequence(F.lit(1), count), lambda i: F.get(F.array(*[F.lit(s) for s in syllables]), (_byte(digest, i) + i) % len(syllables))), "")
        return F.initcap(F.concat(body, F.when(gender == "m", endings[0]).when(gender == "f", endings[1]).otherwise(endings[2])))

    made = F.when(part.rlike(r"\p{IsCyrillic}"), word(CYRILLIC, ("н", "на", "ко"))).otherwise(word(LATIN, ("n", "na", "th")))
    return F.when(part.rlike(r"^[\p{Lu}'-]{2,}$"), F.upper(made)).otherwise(made)


def named_words(m: Column) -> Column:
    """array<struct<seed,shape,gender>> of a name behind a title; gender of given names only."""
    parts = name_parts(m)
    return F.transform(
        parts,
        lambda p, i: F.struct(
            F.concat(F.when(i == F.size(parts) - 1, F.lit("surname:")).otherwise(F.lit("given:")), F.lower(p)).alias("seed"),
            p.alias("shape"),
            F.when(i == F.size(parts) - 1, "s").otherwise(gender_of(m)).alias("gender"),
        ),
    )


def entities(m: Column, names: Column) -> Column:
    """array<struct<seed,shape,gender>>: what of a match gets a surrogate of its own; seed is type and canonical form. ``names``: the document's named_words."""
    kind = kind_of(m)
    one = lambda seed, gender=None: F.array(F.struct(seed.alias("seed"), m.alias("shape"), (F.lit("s") if gender is None else gender).alias("gender")))
    known = F.get(F.filter(names, lambda n: F.lower(n["shape"]) == F.lower(m)), 0)
    return (
        F.when(kind == "name", named_words(m))
        .when(kind == "word", one(known["seed"], known["gender"]))
        .when(kind == "email", one(F.concat(F.lit("email:"), F.lower(m))))
        .when(kind == "ip", one(F.concat(F.lit("ip:"), m)))
        .otherwise(one(F.concat(kind, F.lit(":"), number_of(m))))
    )


def surrogate(key: str, seed: Column, shape: Column, attempt: Column, gender: Column) -> Column:
    digest = _draw(key, seed, attempt)
    longer = F.substring(digest, F.lit(1), F.floor(attempt / LONGER).cast("int"))
    kind = F.substring_index(seed, ":", 1)
    ip = F.array_join(F.transform(F.sequence(F.lit(0), F.lit(3)), lambda i: (_byte(digest, i) % 254 + 1).cast("string")), ".")
    email = F.concat(
        longer, F.lower(same_format(F.regexp_extract(shape, r"^(.*)\.[^.]*$", 1), digest)), F.lit("."), F.regexp_extract(shape, r"([^.]*)$", 1)
    )
    return (
        F.when(kind == "email", email)
        .when(kind == "ip", ip)
        .when(kind.isin("card", "phone", "ssn"), lay(number_digits(seed, digest, attempt), shape))
        .otherwise(_name(shape, gender, digest, attempt))
    )


def found(docs: DataFrame) -> DataFrame:
    """(input struct, text, names, pattern, at, matches, row): the document's named words, and all matches, empty where there is nothing.

    ``pattern`` is null where the document names nobody; then the pattern is ANY where the text has an @, else REST.
    """
    none = F.array().cast("array<string>")
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("input"), "text", F.coalesce(F.col("text").rlike(NAME), F.lit(False)).alias("named"))
    rows = rows.withColumn("gate", F.col("named") | F.coalesce(F.col("text").rlike(GATE), F.lit(False)))
    rows = rows.withColumn("at", F.col("gate") & F.col("text").contains("@"))
    titled = F.when(F.col("named"), F.regexp_extract_all("text", F.lit(NAME), F.lit(0))).otherwise(none)
    rows = rows.select("input", "text", "gate", "at", F.array_distinct(F.flatten(F.transform(titled, named_words))).alias("names"))
    words = F.array_sort(F.array_distinct(F.flatten(F.transform("names", lambda n: F.array(n["shape"], F.upper(n["shape"]), F.initcap(n["shape"]))))))
    first = F.array_join(F.array_distinct(F.transform(words, lambda w: F.substring(w, 1, 1))), "")
    mention = F.concat(F.lit("|(?=["), first, F.lit(r"])(?<![\p{L}'-])(?:"), F.array_join(words, "|"), F.lit(r")(?![\p{L}'-])"))
    pattern = F.when(F.size("names") > 0, F.concat(F.when(F.col("at"), F.lit(ANY)).otherwise(F.lit(REST)), mention))
    rows = rows.select("input", "text", "gate", "at", "names", pattern.alias("pattern"))
    every = lambda p: F.regexp_extract_all("text", p, F.lit(0))
    matches = F.when(F.col("pattern").isNotNull(), every(F.col("pattern"))).when(F.col("at"), every(F.lit(ANY))).when(F.col("gate"), every(F.lit(REST)))
    # The row number keeps filters on the matches from being pushed, expanded, below these projections.
    return rows.select("input", "text", "names", "pattern", "at", F.coalesce(matches, none).alias("matches"), F.monotonically_increasing_id().alias("row"))


def _listed() -> Column:
    return F.transform("matches", lambda m: entities(m, F.col("names")))


def collisions(docs: DataFrame, key: str) -> DataFrame:
    """(seed, attempt, gender) of the entities whose first surrogate is not their own, or that stand behind titles of several genders; a corpus-wide check until none is left."""
    canon = lambda seed, s: F.concat(F.substring_index(seed, ":", 1), F.lit(":"), F.when(seed.rlike("^(?:card|phone|ssn):"), number_of(s)).otherwise(F.lower(s)))
    hits = found(docs.select("text")).where((F.size("matches") > 0) & (F.col("row") >= 0)).select(F.explode(F.flatten(_listed())).alias("e"))
    as_ = lambda g: F.max((F.col("e")["gender"] == g).cast("int"))
    per = hits.groupBy(F.col("e")["seed"].alias("seed")).agg(F.min(F.col("e")["shape"]).alias("shape"), *[as_(g).alias(g) for g in "mfns"])
    gender = F.when(F.col("s") == 1, "s").when(F.col("m") > F.col("f"), "m").when(F.col("f") > F.col("m"), "f").otherwise("n")
    known = materialize(per.select("seed", "shape", gender.alias("gender"), (F.col("m") + F.col("f") + F.col("n") > 1).alias("several")), "entities")
    attempts = known.select("seed", "shape", "gender", "several", F.lit(0).alias("attempt"))
    while True:
        drawn = materialize(attempts.select("*", canon(F.col("seed"), surrogate(key, F.col("seed"), F.col("shape"), F.col("attempt"), F.col("gender"))).alias("made")), "drawn")
        # who drew first keeps it; the other, and whoever drew an entity of the corpus, draws again
        owner = drawn.groupBy(F.col("made").alias("_made")).agg(F.min(F.struct("attempt", "seed")).alias("owner"), F.count("*").alias("n"))
        shared = drawn.join(owner.where("n > 1"), F.col("made") == F.col("_made")).where(F.col("seed") != F.col("owner.seed")).select("seed")
        real = drawn.join(known.select(F.col("seed").alias("_s")), F.col("made") == F.col("_s"), "left_semi").select("seed")
        again = materialize(shared.union(real).distinct().select(F.col("seed").alias("_again")), "again")
        if not again.limit(1).count():
            return drawn.where("attempt > 0 or several").select("seed", "attempt", "gender")
        attempts = drawn.join(again, F.col("seed") == F.col("_again"), "left").select(
            "seed", "shape", "gender", "several", (F.col("attempt") + F.when(F.col("_again").isNotNull(), 1).otherwise(0)).alias("attempt")
        )


def replace_pii(docs: DataFrame, key: str, counted: str | None = "n_found") -> DataFrame:
    """``docs`` with surrogates in text (n_chars to match, if there is one), and in column ``counted``, if named, how many spans were replaced."""
    names = [c for c in docs.columns if c != counted]
    redrawn = materialize(collisions(docs, key), "redrawn")
    rows = found(docs)
    if redrawn.limit(1).count():
        # rows of one text have the same entities; should two texts share a hash, they share a list, of which each takes its own
        rows = rows.withColumn("of", F.xxhash64("text"))
        hits = rows.where((F.size("matches") > 0) & (F.col("row") >= 0)).select("of", F.explode(F.flatten(_listed())).alias("e")).select("of", F.col("e.seed").alias("seed")).distinct()
        again = hits.join(redrawn, "seed").groupBy(F.col("of").alias("_of")).agg(F.collect_list(F.struct("seed", "attempt", "gender")).alias("again"))
        rows = rows.join(again, F.col("of") == F.col("_of"), "left")
        drawn = lambda e, name: F.get(F.filter("again", lambda a: a["seed"] == e["seed"]), 0)[name]
        new_word = lambda e: surrogate(key, e["seed"], e["shape"], F.coalesce(drawn(e, "attempt"), F.lit(0)), F.coalesce(drawn(e, "gender"), e["gender"]))
    else:
        new_word = lambda e: surrogate(key, e["seed"], e["shape"], F.lit(0), e["gender"])
    made = rows.select("*", _listed().alias("listed"))

    def new_text(m, i):
        words = F.array_join(F.transform(F.get("listed", i), new_word), " ")
        return F.when(kind_of(m) == "name", F.concat(title_of(m), F.lit(" "), words)).otherwise(words)

    gaps = F.when(F.col("pattern").isNotNull(), F.split("text", F.col("pattern"), -1)).when(F.size("matches") == 0, None).when(F.col("at"), F.split("text", ANY, -1)).otherwise(F.split("text", REST, -1))
    made = made.select("*", gaps.alias("gaps"), F.transform("matches", new_text).alias("new"))
    text = F.when(
        F.size("matches") > 0, F.array_join(F.transform("gaps", lambda g, i: F.concat(g, F.coalesce(F.get("new", i), F.lit("")))), "")
    ).otherwise(F.col("text"))
    made = made.select("input", text.alias("text"), F.size("matches").alias("found"))
    changed = {"text": F.col("text")}
    if "n_chars" in names:
        changed["n_chars"] = F.length("text").cast(docs.schema["n_chars"].dataType)
    return made.select(*[changed.get(c, F.col("input")[c]).alias(c) for c in names], *([F.col("found").alias(counted)] if counted else []))


def key_of(spark: SparkSession) -> str:
    return spark.conf.get(KEY_SETTING, OPEN_KEY)


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return replace_pii(docs, key_of(spark)).select("doc_id", "text", F.col("n_found").cast("long"))
