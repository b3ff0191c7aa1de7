"""PII (3), native: keyed surrogates for detected entities.  DataFrame functions only: no Python runs on executors.

Detected are e-mail addresses (local parts in any alphabetic script), IPv4 addresses, telephone numbers, card numbers that
Luhn's check proves, account numbers (IBAN), access keys, secrets that follow their name, full names that begin with a
known given name, and names that follow a title.  Each type has its own border to the left, so that an entity may
follow a full stop, a hyphen, or text without blanks.  A text is split at its entities, each is replaced, and the pieces
are joined again.  A surrogate is drawn from a keyed hash of the entity's canonical form, so one entity is replaced
alike wherever and however it is written; it keeps type and format (lengths, separators, case, scripts of local parts,
country codes, first digit and Luhn validity of cards, private network prefixes, top-level domains, titles) and, for
names, gender and script.  Where the family name of a name found in a text stands alone in it, it becomes the family name
of that surrogate.

The key comes from the caller or from the session (``spark.ashlar.pii.key``).  Without one a random key is drawn for
the application and kept nowhere, so nobody can compute its surrogates again.

Distinctness is checked over the corpus: the surrogates of all distinct entities are compared with each other and with
the real entities of their type; whichever meets one is drawn again with the next attempt until none does.  After attempt
``ROOMY`` the space grows with each: surrogates get longer, names more family names, addresses leave their private network
and at last are IPv6, so that every entity gets one however few there are of its format.  Attempts other than the first
are few and are joined back to the documents; the rest of the corpus is one pass.

Defined results: a null text stays null and has no entities; empty and entity-free texts stay as they are; repeated rows
are replaced alike; other columns are kept by ``replace``, whatever their names; an empty table gives an empty result.
"""

from __future__ import annotations

import secrets

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fresh, prepare, table
from .components import stored

KEY_SETTING = "spark.ashlar.pii.key"
#: Rows of redrawn entities up to which they are broadcast; beyond, they are joined by a shuffle.
BROADCAST_ROWS = 10_000

#: Of which letters are drawn.
_CONSONANTS = "bcdfghjklmnpqrst"
#: Attempts within the format of the entity; each one after has a larger space.
ROOMY = 2

#: (script, gender): given names.  A name is replaced from its own list.
GIVEN = {
    ("latin", "f"): "Anna Maria Laura Julia Sophie Emma Claire Camille Isabelle Carmen Lucía Elena Martina Katharina Sabine Ingrid Jennifer Jessica Elizabeth Margaret Susan Patricia Mary Linda Barbara Sarah Karen Nancy Lisa Emily Olivia Amanda Rachel Petra Ursula Monika Brigitte Marie Catherine Nathalie Juliette Sofía Pilar Rosa Giulia Francesca".split(),
    ("latin", "m"): "James Robert Michael William Richard Thomas Charles Daniel Matthew Klaus Jürgen Wolfgang Stefan Pierre Jacques François Philippe Carlos Javier Alejandro Miguel Antonio John David Peter Joseph Andrew George Edward Steven Kevin Brian Henry Hans Karl Andreas Markus Jean Louis Nicolas Antoine José Juan Luis Pedro Marco Giovanni".split(),
    ("cyrillic", "f"): "Мария Анна Елена Ольга Наталья Татьяна Ирина Светлана".split(),
    ("cyrillic", "m"): "Александр Дмитрий Сергей Андрей Алексей Михаил Николай Владимир".split(),
    ("greek", "f"): "Μαρία Ελένη Κατερίνα Βασιλική Σοφία Αγγελική".split(),
    ("greek", "m"): "Γιώργος Γιάννης Κώστας Δημήτρης Νίκος Παναγιώτης".split(),
}
FAMILY = {
    ("latin", "f"): "Adler Brandt Carter Dubois Evans Fischer Garnier Hoffmann Ibarra Jensen Keller Lambert Moreno Navarro Olsen Porter Quinn Romero Sanders Taylor Ulrich Vargas Walker Young Zimmermann".split(),
    ("cyrillic", "f"): "Иванова Смирнова Кузнецова Попова Соколова Лебедева Козлова Новикова Морозова Волкова".split(),
    ("cyrillic", "m"): "Иванов Смирнов Кузнецов Попов Соколов Лебедев Козлов Новиков Морозов Волков".split(),
    ("greek", "f"): "Παπαδοπούλου Γεωργίου Δημητρίου Νικολάου Ιωάννου Βασιλείου".split(),
    ("greek", "m"): "Παπαδόπουλος Γεωργίου Δημητρίου Νικολάου Ιωάννου Βασιλείου".split(),
}
FAMILY["latin", "m"] = FAMILY["latin", "f"]
#: Titles of a woman and of others, before one or two names.
TITLES = {"f": "Mrs Ms Miss Frau Señora Sra Madame Mme Signora".split(), "m": "Mr Dr Prof Herr Señor Monsieur Signor".split()}

_NAMES = "|".join(sorted({x for v in GIVEN.values() for x in v}, key=lambda x: (-len(x), x)))
_TITLED = rf"(?:{'|'.join(TITLES['f'] + TITLES['m'])})[.]? "
_WORD = r"\p{Lu}[\p{L}'-]{1,30}"
_OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
_LABEL = r"(?i:token|secret|password|passwd|pwd|api[_-]?key)[ ]{0,2}[=:][ ]{0,2}[\"']?"
#: Letters of scripts that write words apart, digits: those without blanks between words border an entity.
_LETTER = r"[\p{L}\p{M}\p{N}&&[^\p{IsHan}\p{IsHiragana}\p{IsKatakana}\p{IsThai}]]"
#: In order: where two begin at one place, the first one named is taken.  A match of ``secret`` has its label with it.
PATTERNS = {
    "email": rf"(?:{_LETTER}|[_%+-])(?:{_LETTER}|[._%+-]){{0,63}}@(?:[\p{{L}}\p{{N}}-]{{1,63}}\.){{1,8}}[A-Za-z]{{2,24}}",
    "ip": rf"(?:{_OCTET}\.){{3}}{_OCTET}(?![\w]|\.\d)",
    "phone": r"\+1[ .-]?\(?\d{3}\)?[ .-]?\d{3}[ .-]?\d{4}(?!\d)|\+\d{7,15}(?!\d)|\+(?=(?:[ .()-]{0,2}\d){7,15}(?!\d))\d{1,3}(?:[ .-]?\(\d{1,4}\))?(?:[ .-]\d{1,8}){1,6}(?!\d)|\(\d{3}\) ?\d{3}[ .-]\d{4}(?!\d)|\d{3}[.-]\d{3}[.-]\d{4}(?![\w-])",
    "card": r"(?:[3-6]\d|2[2-7])\d{2}(?:[ -]?\d){9,15}(?!\w)",
    "ssn": r"\d{3}-\d{2}-\d{4}(?![\w-])",
    "key": r"(?:AKIA|ASIA)[A-Z0-9]{16}(?!\w)|gh[pousr]_[A-Za-z0-9]{36,}(?!\w)|sk-[A-Za-z0-9]{20,}(?!\w)",
    "secret": _LABEL + r"[A-Za-z0-9_+/.=-]{7,}[A-Za-z0-9_+/=-]",
    "iban": r"[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?!\w)",
    "name": rf"(?:{_NAMES}) {_WORD}(?!\p{{L}})|{_TITLED}{_WORD}(?: {_WORD})?(?!\p{{L}})",
}
#: What may not stand before an entity.
_LETTER_BEFORE, _NUMBER_BEFORE = r"(?<![\p{IsLatin}\d_])", r"(?<![\p{IsLatin}\d_])(?<!\d[.-])"
BORDERS = {"email": rf"(?<!{_LETTER}|[_%+-])", "ip": r"(?<![\p{IsLatin}\d_])(?<!\d\.)", "phone": r"(?<![\p{IsLatin}\d_+](?=[\d(]))(?<![\d+])(?<!\d[.-])", "card": _NUMBER_BEFORE, "ssn": _NUMBER_BEFORE, "key": _LETTER_BEFORE, "secret": r"(?<![A-Za-z0-9])", "iban": _LETTER_BEFORE, "name": r"(?<!\p{L})"}
# one look ahead settles nearly every place of a text: an entity begins with one of few signs
PATTERN = r"(?=[A-Z0-9+(_%\p{Lu}-]|[\p{L}\p{N}._%+-]{1,64}@|(?i:token|secret|pass|pwd|api)|gh|sk-)(?:" + "|".join(f"{BORDERS[k]}(?:{p})" for k, p in PATTERNS.items()) + ")"


def kind_of(e: Column) -> Column:
    """The type of a matched entity, by its own form; none of a number that looks like a card's and is not."""
    out = F.when(e.contains("@") & e.rlike(r"@[\p{L}\p{N}.-]+\.[A-Za-z]{2,24}$"), "email")
    for kind, form in (("ip", r"^\d{1,3}(\.\d{1,3}){3}$"), ("phone", r"^[+(]|^\d{3}[.-]\d{3}[.-]\d{4}$"), ("ssn", r"^\d{3}-\d{2}-\d{4}$"), ("card", r"^[2-6][\d -]{12,}$"), ("key", r"^(?:(?:AKIA|ASIA)[A-Z0-9]{16}$|gh[pousr]_|sk-)"), ("iban", r"^[A-Z]{2}\d{2}[A-Z0-9 ]+$"), ("name", rf"^(?:(?:{_NAMES}) |{_TITLED})")):
        out = out.when(e.rlike(form), F.when(_luhn(F.regexp_replace(e, r"\D", "")) % 10 == 0, kind).otherwise("none") if kind == "card" else F.lit(kind))
    return out.otherwise("secret")


def _value(e: Column) -> Column:
    """A secret without its label."""
    return F.regexp_replace(e, "^" + _LABEL, "")


def canonical(kind: Column, e: Column) -> Column:
    """What all spellings of one entity share."""
    digits = F.regexp_replace(e, r"\D", "")
    return F.when(kind.isin("phone", "card", "ssn"), digits).when(kind == "email", F.lower(e)).when(kind == "iban", F.regexp_replace(e, " ", "")).when(kind == "secret", _value(e)).when(kind == "name", F.regexp_replace(e, "^" + _TITLED, "")).otherwise(e)


def _stream(key: str, *parts: Column) -> Column:
    """64 keyed hexadecimal digits."""
    return F.sha2(F.concat_ws("\u0001", F.lit(key), *[p.cast("string") for p in parts]), 256)


def _format(e: Column, digits: Column, letters: Column, keep: Column) -> Column:
    """e with each letter and digit after the first ``keep`` ones replaced from a stream, case, script and signs as they were."""
    start = F.struct(F.lit("").alias("out"), F.lit(0).alias("n"))

    def step(acc: Column, c: Column) -> Column:
        at = F.pmod(acc["n"], F.lit(64)) + 1
        letter = letters.substr(at, F.lit(1))
        own = F.when(c.rlike(r"^\p{IsCyrillic}$"), F.translate(letter, _CONSONANTS, "бвгджзклмнпрстфх")).when(c.rlike(r"^\p{IsGreek}$"), F.translate(letter, _CONSONANTS, "βγδζθκλμνξπρστφχ")).otherwise(letter)
        new = F.when(acc["n"] < keep, c).when(c.rlike(r"^\p{N}$"), digits.substr(at, F.lit(1))).when(c.rlike(r"^\p{Lu}$"), F.upper(own)).when(c.rlike(r"^\p{L}$"), own).otherwise(c)
        return F.struct(F.concat(acc["out"], new).alias("out"), (acc["n"] + F.when(c.rlike(r"^[\p{L}\p{N}]$"), 1).otherwise(0)).alias("n"))

    return F.aggregate(F.split(e, ""), start, step)["out"]


def _luhn(digits: Column) -> Column:
    """The Luhn sum of a string of digits, the last one's place first."""
    turned = F.split(F.reverse(digits), "")
    each = F.transform(turned, lambda c, i: F.when(i % 2 == 0, c.cast("int")).otherwise(F.when(c.cast("int") > 4, 2 * c.cast("int") - 9).otherwise(2 * c.cast("int"))))
    return F.aggregate(each, F.lit(0), lambda a, x: a + F.coalesce(x, F.lit(0)))


def _card(e: Column, zeros: Column, digits: Column, letters: Column) -> Column:
    """Valid by Luhn as e is: the last digit is set right."""
    drawn = _format(F.concat(e, zeros), digits, letters, F.lit(1))
    plain = F.regexp_replace(drawn, r"\D", "")
    check = F.pmod(F.lit(10) - _luhn(F.concat(plain.substr(F.lit(1), F.length(plain) - 1), F.lit("0"))) % 10, F.lit(10))
    return F.concat(drawn.substr(F.lit(1), F.length(drawn) - 1), check.cast("string"))


def _number(stream: Column, at: int | Column) -> Column:
    return F.conv(stream.substr(at, F.lit(4) if isinstance(at, Column) else 4), 16, 10).cast("int")


def _pick(names: list[str], stream: Column, at: int | Column) -> Column:
    return F.element_at(F.split(F.lit(",".join(names)), ","), _number(stream, at) % len(names) + 1)


def _name(e: Column, h: Column, attempt: Column) -> Column:
    title = F.regexp_extract(e, "^" + _TITLED, 0)
    bare = e.substr(F.length(title) + 1, F.length(e))
    given = F.concat(F.lit(","), F.substring_index(bare, " ", 1), F.lit(","))
    woman = F.lit("," + ",".join(TITLES["f"]) + ",").contains(F.concat(F.lit(","), F.regexp_replace(title, "[. ]", ""), F.lit(",")))
    two = bare.contains(" ")
    parts = F.sequence(F.lit(1), F.least(F.greatest(attempt - ROOMY, F.lit(0)) + 1, F.lit(15)))
    out = F.lit(None).cast("string")
    for (script, gender), names in GIVEN.items():
        # a second and further family names once single ones run short
        family = F.array_join(F.transform(parts, lambda k: _pick(FAMILY[script, gender], h, 4 * k + 1)), "-")
        full = F.when(two, F.concat_ws(" ", _pick(names, h, 1), family)).otherwise(family)
        fits = F.lit("," + ",".join(names) + ",").contains(given)
        if script == "latin":  # of a name that no list has, the title tells
            fits = fits | (out.isNull() & (title != "") & (woman if gender == "f" else ~woman))
        out = F.when(fits, full).otherwise(out)
    return F.concat(title, out)


def surrogates(found: Column, attempt, key: str) -> Column:
    """The replacements of an array of entities as written; attempt(i) is the attempt of the one at i.

    What a later step needs is computed once, in a field of its own, so that the plan stays small.
    """
    steps = [
        lambda e, i: F.struct(e.alias("e"), kind_of(e).alias("kind"), attempt(i).alias("attempt")),
        lambda x: x.withField("h", _stream(key, x["kind"], canonical(x["kind"], x["e"]), x["attempt"])).withField("host", F.substring_index(x["e"], "@", -1)).withField("value", _value(x["e"])).withField("more", F.greatest(x["attempt"] - ROOMY, F.lit(0))),
        lambda x: x.withField("dh", _stream(key, F.lit("domain"), F.lower(x["host"]))).withField("digits", F.translate(x["h"], "abcdef", "274951")).withField("letters", F.translate(x["h"], "0123456789abcdef", _CONSONANTS)),
        _draw,
    ]
    out = found
    for step in steps:
        out = F.transform(out, step)
    return out


def _draw(x: Column) -> Column:
    kind, e, h, digits, letters, host, value = (x[c] for c in ("kind", "e", "h", "digits", "letters", "host", "value"))
    none, more = F.lit(0), x["more"]
    # what is longer than the entity is drawn like the rest of it
    long, zeros = F.repeat(F.lit("a"), more), F.repeat(F.lit("0"), more)
    email = F.concat(_format(F.concat(F.substring_index(e, "@", 1), long), digits, letters, none), F.lit("@"), _format(F.regexp_replace(host, r"\.[^.]*$", ""), F.translate(x["dh"], "abcdef", "274951"), F.translate(x["dh"], "0123456789abcdef", _CONSONANTS), none), F.lit("."), F.substring_index(e, ".", -1))
    octets = F.concat_ws(".", (_number(h, 1) % 100 + 23).cast("string"), *[(_number(h, 5 * i + 1) % 254 + 1).cast("string") for i in (1, 2, 3)])
    private = F.regexp_extract(e, r"^(10\.|127\.|192\.168\.|172\.(?:1[6-9]|2\d|3[01])\.)", 1)
    ip = F.concat(private, F.when(private == "", octets).when(private.rlike(r"\..*\."), F.substring_index(octets, ".", -2)).otherwise(F.substring_index(octets, ".", -3)))
    ip = F.when(more == 0, ip).when((more <= 4) & (private != ""), F.concat(F.lit("10."), F.substring_index(octets, ".", -3))).when(more <= 8, octets).otherwise(F.concat(F.lit("2001:db8"), *[F.concat(F.lit(":"), h.substr(k, 4)) for k in range(25, 49, 4)]))
    country = F.length(F.regexp_extract(e, r"^\+(1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|\d{3})", 1))
    hexed = value.rlike("^[0-9a-f]+$")
    secret = F.concat(e.substr(F.lit(1), F.length(e) - F.length(value)), _format(F.concat(value, long), F.when(hexed, h).otherwise(digits), F.when(hexed, h).otherwise(letters), none))
    keep = F.when(kind == "phone", country).when(kind == "iban", 2).when((kind == "key") & e.startswith("A"), 4).when(kind == "key", 2).otherwise(0)
    return F.when(kind == "none", e).when(kind == "email", email).when(kind == "ip", ip).when(kind == "card", _card(e, zeros, digits, letters)).when(kind == "name", _name(e, h, x["attempt"])).when(kind == "secret", secret).otherwise(_format(F.concat(e, F.when(kind == "key", long).otherwise(zeros)), digits, letters, keep))


def entities(docs: DataFrame) -> DataFrame:
    """Distinct (kind, canon) with one spelling."""
    found = docs.select(F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(PATTERN), F.lit(0)))).alias("e"))
    typed = found.withColumn("kind", kind_of(F.col("e"))).where("kind != 'none'").withColumn("canon", canonical(F.col("kind"), F.col("e")))
    return typed.groupBy("kind", "canon").agg(F.min("e").alias("e"))


def redrawn(docs: DataFrame, key: str) -> DataFrame:
    """(kind, canon, attempt) of the entities whose first surrogate is another entity, or another's surrogate."""
    real = stored(entities(docs), "entities")
    pending, taken, out = real.withColumn("attempt", F.lit(0)), real.select("kind", F.col("canon").alias("s")), None
    surrogate = surrogates(F.array("e"), lambda _: F.col("attempt"), key)[0]  # a large expression, made once for all rounds
    while True:
        drawn = pending.select("*", surrogate.alias("raw"))
        # once in one plan without a shuffle: its form needs it several times, and so does the join
        drawn = stored(drawn.withColumn("s", canonical(F.col("kind"), F.col("raw"))).drop("raw"), "drawn")
        # of those that drew the same, the first keeps it, unless it is taken: an aggregate, not a sort of the group
        first = drawn.groupBy("kind", "s").agg(F.min("canon").alias("canon")).join(taken, ["kind", "s"], "left_anti").select("kind", "canon", F.lit(True).alias("ok"))
        drawn = stored(drawn.join(first, ["kind", "canon"], "left"), "surrogates")
        good = drawn.where("ok and attempt > 0").select("kind", "canon", "attempt")
        out = good if out is None else out.unionByName(good)
        pending = drawn.where("ok is null").select("kind", "canon", "e", (F.col("attempt") + 1).alias("attempt"))
        if pending.isEmpty():
            return out
        taken = taken.unionByName(drawn.where("ok").select("kind", "s"))


_drawn: dict[str, str] = {}


def key_of(spark: SparkSession) -> str:
    """The session's key, or the application's random one."""
    return spark.conf.get(KEY_SETTING, None) or _drawn.setdefault(spark.sparkContext.applicationId, secrets.token_hex(32))


def replace(docs: DataFrame, key: str | None = None, kinds: str = "_pii_kinds") -> DataFrame:
    """The documents with surrogates in their texts, other columns as they were, and a column ``kinds`` of what was replaced."""
    key = key or key_of(docs.sparkSession)
    names = docs.columns
    found, again_, hashed, length, new_ = (fresh(names, x) for x in ("_pii_found", "_pii_again", "_pii_h", "_pii_n", "_pii_new"))
    again = stored(redrawn(docs, key), "redrawn")
    docs = docs.withColumn(found, F.regexp_extract_all("text", F.lit(PATTERN), F.lit(0)))
    n = again.count()
    if n:
        # documents are told by their text; those that hold a redrawn entity get its attempts by place
        mine = docs.where(F.size(found) > 0).select(F.xxhash64("text").alias(hashed), F.length("text").alias(length), F.col(found).alias("found")).distinct().select(hashed, length, F.posexplode("found").alias("p", "e"))
        mine = mine.withColumn("kind", kind_of(F.col("e"))).withColumn("canon", canonical(F.col("kind"), F.col("e")))
        small = n <= BROADCAST_ROWS
        mine = mine.join(F.broadcast(again) if small else again, ["kind", "canon"]).groupBy(hashed, length).agg(F.map_from_entries(F.collect_list(F.struct("p", "attempt"))).alias(again_))
        mine = stored(mine, "again")
        few = mine.count() <= BROADCAST_ROWS
        docs = docs.withColumns({hashed: F.xxhash64("text"), length: F.length("text")}).join(F.broadcast(mine) if few else mine, [hashed, length], "left").drop(hashed, length)
        attempt = lambda i: F.coalesce(F.element_at(again_, i), F.lit(0))
    else:
        attempt = lambda i: F.lit(0)
    docs = docs.withColumn(new_, surrogates(F.col(found), attempt, key))
    # family names that stand alone
    named = F.filter(F.zip_with(found, new_, lambda e, s: F.struct(e.alias("e"), s.alias("s"))), lambda x: kind_of(x["e"]) == "name")
    alone = F.transform(named, lambda x: F.struct(F.concat(F.lit(r"(?<![\p{L}'-])"), F.substring_index(x["e"], " ", -1), F.lit(r"(?![\p{L}'-])")).alias("e"), F.substring_index(x["s"], " ", -1).alias("s")))
    gaps = F.split("text", PATTERN, -1)
    cleaned = F.transform(gaps, lambda g: F.aggregate(alone, g, lambda text, x: F.regexp_replace(text, x["e"], x["s"])))
    gaps = F.when(F.exists(found, lambda e: e.rlike(rf"^(?:(?:{_NAMES}) |{_TITLED})")), cleaned).otherwise(gaps)
    joined = F.concat_ws("", F.flatten(F.zip_with(gaps, new_, lambda g, s: F.array(g, F.coalesce(s, F.lit(""))))))
    what = F.filter(F.transform(found, kind_of), lambda k: k != "none")
    out = docs.withColumns({"text": F.when(F.size(found) > 0, joined).otherwise(F.col("text")), kinds: F.coalesce(what, F.array().cast("array<string>"))})
    return out.select(*[F.col(f"`{c}`") for c in [*names, kinds]])


def _count(kind: str) -> Column:
    return F.size(F.filter("_pii_kinds", lambda k: k == kind)).cast("long")


def op3_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, text with surrogates, n_replaced and how many of each type."""
    prepare(spark)
    out = replace(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "text", F.size("_pii_kinds").cast("long").alias("n_replaced"), *[_count(x).alias(f"n_{x}") for x in PATTERNS])
