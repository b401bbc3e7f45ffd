"""Surrogates for personal data.

Patterns find e-mail and IP addresses (both versions), phone, identity and card numbers, bank accounts, keys in hexadecimal and names
after a title. Every distinct entity gets a surrogate that a keyed hash draws for its canonical form: the same entity
has the same surrogate in all documents and spellings. Surrogates keep type, format, letter case, script and, for names,
the gender that the title tells; valid check digits stay valid. Draws that meet another surrogate or a real entity are drawn anew, until all differ.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lociflow.llm.common import fresh, shared_dir, stored

OCTET = r"(?:25[0-5]|2[0-4]\d|1?\d?\d)"
# Titles that tell a gender.
TITLES = {
    "m": ("Mr", "Herr", "Sr", "Señor", "Monsieur", "Don", "г-н", "господин", "Κύριος"),
    "f": ("Mrs", "Ms", "Miss", "Mme", "Mlle", "Madame", "Frau", "Sra", "Srta", "Señora", "Doña", "г-жа", "госпожа", "Κυρία"),
}
ANY_TITLE = "|".join(sorted((t for ts in TITLES.values() for t in ts), key=len, reverse=True))
NAME = r"\p{Lu}[\p{L}'’-]{1,40}"
IP = rf"(?<![\d.])(?:{OCTET}\.){{3}}{OCTET}(?!\d|\.\d)"
#: A group of a phone number does not start an address.
NO_IP = rf"(?!{IP})"
HEX4 = "[0-9A-Fa-f]{1,4}"
#: Kind -> pattern, in the order in which they are tried. Lookarounds keep matches whole and scans linear.
PATTERNS = {
    "email": r"(?<![\p{L}\p{N}._%+-])[\p{L}\p{N}._%+-]++@[A-Za-z0-9-]{1,63}(?:\.[A-Za-z0-9-]{1,63})*\.[A-Za-z]{2,24}",
    "ip": IP,
    "ipv6": rf"(?<![\p{{L}}\p{{N}}:])(?=[A-Fa-f:]*+\d)(?:(?:{HEX4}:){{7}}{HEX4}|(?:{HEX4}:){{1,6}}(?::{HEX4}){{1,6}})(?![\p{{L}}\p{{N}}:])",
    "phone": rf"(?<![\p{{L}}\d+])\+\d{{1,3}}(?:[ .-]?\(\d{{1,4}}\)|[ .-]{NO_IP}\d(?=[ .-]\d))?[ .-]?{NO_IP}\d{{2,4}}(?:[ .-]?{NO_IP}\d{{2,4}}){{1,4}}(?!\d)|(?<!\d)\(\d{{3}}\) ?\d{{3}}-\d{{4}}(?!\d)|(?<![\d-])\d{{3}}-\d{{3}}-\d{{4}}(?![\d-])|(?<![\d.])\d{{3}}\.\d{{3}}\.\d{{4}}(?![\d.]*\d)|(?<!\d)(?<!\d[ -])\d{{3}} \d{{3}} \d{{4}}(?![ -]?\d)",
    "ssn": r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])",
    "hex": r"(?<![0-9A-Za-z])(?=[A-Fa-f]*+\d)[0-9A-Fa-f]{32,128}(?![0-9A-Za-z])",
    "card": r"(?<!\d)\d(?:[ -]?\d){12,18}(?!\d)",
    "iban": r"(?<![0-9A-Za-z])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![0-9A-Za-z])",
    "name": rf"(?<![\p{{L}}\p{{N}}])(?:{ANY_TITLE})\.? {NAME}(?: {NAME}){{0,2}}",
}
ANY = "|".join(f"(?:{p})" for p in PATTERNS.values())
#: What every match contains: texts without it are not searched further.
HINT = rf"[@0-9]|(?:{ANY_TITLE})\.? \p{{Lu}}"
# Given names by script and gender, and syllables for family names and further draws.
GIVEN = {
    ("latin", "m"): ("Adrian", "Bruno", "Carlos", "David", "Emil", "Felix", "Georg", "Hugo", "Ivan", "Julian", "Konrad", "Leon", "Martin", "Noel", "Oscar", "Paul"),
    ("latin", "f"): ("Alice", "Bianca", "Clara", "Diana", "Elena", "Flora", "Greta", "Helena", "Irene", "Julia", "Karla", "Lucia", "Maria", "Nora", "Olivia", "Paula"),
    ("cyrillic", "m"): ("Антон", "Борис", "Виктор", "Денис", "Егор", "Максим", "Павел", "Роман"),
    ("cyrillic", "f"): ("Алина", "Вера", "Дарья", "Елена", "Ирина", "Мария", "Ольга", "София"),
    ("greek", "m"): ("Γιώργος", "Δημήτρης", "Νίκος", "Πέτρος"),
    ("greek", "f"): ("Άννα", "Ελένη", "Μαρία", "Σοφία"),
}
SYLLABLES = {
    "latin": ("ba", "den", "fol", "gar", "hil", "kov", "lan", "mer", "nor", "pel", "rin", "sta", "tor", "vel", "wes", "zan"),
    "cyrillic": ("ба", "ве", "гор", "ден", "зан", "кор", "лин", "мар", "нов", "пет", "род", "сол", "тар", "фед", "хор", "шин"),
    "greek": ("βα", "γορ", "δη", "ζαν", "θε", "κορ", "λιν", "μαρ", "νικ", "παπ", "ροδ", "σολ", "τασ", "φιλ", "χρι", "ψαλ"),
}
ENDINGS = {("latin", "m"): "o", ("latin", "f"): "a", ("cyrillic", "m"): "ов", ("cyrillic", "f"): "ова", ("greek", "m"): "ος", ("greek", "f"): "η"}
#: Letters that stand for those of other scripts in mail addresses.
LETTERS = {"Cyrillic": "абвгдежзиклмнопрстуфхцчшэюя", "Greek": "αβγδεζηθικλμνξοπρστυφχψω"}


def _case(value: Column, options: dict[str, Column]) -> Column:
    first, *rest = options.items()
    return reduce(lambda c, o: c.when(value == o[0], o[1]), rest, F.when(value == first[0], first[1]))


def _digits(text: Column) -> Column:
    return F.regexp_replace(text, r"\D", "")


def classify(entity: Column) -> Column:
    """The first kind whose pattern matches the whole entity."""
    return F.coalesce(*[F.when(entity.rlike(rf"\A(?:{p})\z"), F.lit(k)) for k, p in PATTERNS.items()])


def _country(entity: Column) -> Column:
    """The country code of a phone number that writes it apart, else empty."""
    return F.regexp_extract(entity, r"\A\+(\d{1,3})(?=[ .(-])", 1)


def _script(word: Column) -> Column:
    return F.when(word.rlike(r"\p{IsCyrillic}"), F.lit("cyrillic")).when(word.rlike(r"\p{IsGreek}"), F.lit("greek")).otherwise(F.lit("latin"))


def _name_words(entity: Column) -> Column:
    return F.split(F.regexp_replace(entity, rf"\A(?:{ANY_TITLE})\.? ", ""), " ")


def parts_of(entity: Column, kind: Column) -> Column:
    """What of an entity has a surrogate of its own, as (kind, canonical form): each word of a name, else the whole."""
    gender = F.when(F.regexp_extract(entity, rf"\A({ANY_TITLE})", 1).isin(*TITLES["f"]), F.lit("f")).otherwise(F.lit("m"))
    words = _name_words(entity)
    named = F.transform(
        words,
        lambda w, i: F.struct(
            # Latin family names have no gender, so that those of a couple stay one name
            F.when(i < F.size(words) - 1, F.concat(F.lit("given-"), _script(w), F.lit("-"), gender))
            .when(_script(w) == "latin", F.lit("family-latin"))
            .otherwise(F.concat(F.lit("family-"), _script(w), F.lit("-"), gender))
            .alias("kind"),
            F.lower(w).alias("canon"),
        ),
    )
    canon = _case(
        kind,
        {
            "email": F.lower(entity),
            "ip": entity,
            "ipv6": F.lower(entity),
            "phone": F.concat(_country(entity), F.lit("|"), _digits(entity)),
            "ssn": _digits(entity),
            "hex": F.lower(entity),
            "card": _digits(entity),
            "iban": F.replace(entity, F.lit(" "), F.lit("")),
        },
    )
    return F.when(kind == "name", named).otherwise(F.array(F.struct(kind.alias("kind"), canon.alias("canon"))))


def _stream(key: str, seed: Column, characters: Column) -> Column:
    """Hexadecimal digits of keyed hashes, at least two for each character."""
    block = lambda b: F.sha2(F.concat(F.lit(f"{key}|"), seed, F.lit("|"), b.cast("string")), 256)
    return F.array_join(F.transform(F.sequence(F.lit(0), F.floor(characters / 32).cast("int")), block), "")


def _byte(stream: Column, i: Column | int) -> Column:
    return F.conv(F.substring(stream, i * 2 + 1, F.lit(2)) if isinstance(i, Column) else F.substring(stream, 2 * i + 1, 2), 16, 10).cast("int")


def _pick(letters: str, byte: Column) -> Column:
    return F.substring(F.lit(letters), byte % len(letters) + 1, F.lit(1))


def _like(text: Column, stream: Column, keep: Column, hexadecimal: bool = False) -> Column:
    """Draws each letter and digit of ``text`` anew within its class, but for the first ``keep`` characters."""

    def draw(c: Column, i: Column) -> Column:
        b = _byte(stream, i)
        if hexadecimal:
            return F.when(c == ":", c).otherwise(_pick("0123456789abcdef", b))
        return (
            F.when(i < keep, c)
            .when(c.rlike("[0-9]"), _pick("0123456789", b))
            .when(c.rlike("[A-Z]"), _pick("ABCDEFGHIJKLMNOPQRSTUVWXYZ", b))
            .when(c.rlike(r"\p{IsCyrillic}"), _pick(LETTERS["Cyrillic"], b))
            .when(c.rlike(r"\p{IsGreek}"), _pick(LETTERS["Greek"], b))
            .when(c.rlike(r"\p{L}"), _pick("abcdefghijklmnopqrstuvwxyz", b))
            .otherwise(c)
        )

    return F.array_join(F.transform(F.split(text, ""), draw), "")


def _luhn(body: Column) -> Column:
    """The check digit that card numbers end with."""
    doubled = F.transform(F.split(F.reverse(body), ""), lambda c, i: F.when(i % 2 == 0, c.cast("int") * 2 - F.when(c.cast("int") > 4, 9).otherwise(0)).otherwise(c.cast("int")))
    return ((10 - F.aggregate(doubled, F.lit(0), lambda s, x: s + x) % 10) % 10).cast("string")


def _mod97(characters: Column) -> Column:
    """The remainder of account numbers, letters counting from 10."""
    number = lambda c: F.when(c.rlike("[0-9]"), c.cast("int")).otherwise(F.ascii(c) - 55)
    return F.aggregate(F.split(characters, ""), F.lit(0), lambda s, c: (s * F.when(c.rlike("[0-9]"), 10).otherwise(100) + number(c)) % 97)


def _card(canon: Column, drawn: Column) -> Column:
    """``drawn`` with a valid check digit if ``canon`` has one."""
    body = lambda x: F.substring(x, F.lit(1), F.length(x) - 1)
    return F.when(F.substring(canon, -1, 1) == _luhn(body(canon)), F.concat(body(drawn), _luhn(body(drawn)))).otherwise(drawn)


def _iban(canon: Column, drawn: Column) -> Column:
    """``drawn`` with valid check digits if ``canon`` has them."""
    country, rest = F.substring(drawn, 1, 2), F.substring(drawn, F.lit(5), F.length(drawn) - 4)
    digits = F.lpad((98 - _mod97(F.concat(rest, country, F.lit("00")))).cast("string"), 2, "0")
    valid = _mod97(F.concat(F.substring(canon, F.lit(5), F.length(canon) - 4), F.substring(canon, 1, 4))) == 1
    return F.when(valid, F.concat(country, digits, rest)).otherwise(drawn)


def draw(key: str, kind: Column, canon: Column, turn: int) -> Column:
    """The surrogate of a canonical form in one round of draws."""
    seed = F.concat_ws("|", kind, canon, F.lit(str(turn)))
    stream = _stream(key, seed, F.length(canon) + 64)
    more = max(0, turn - 3)  # from here on each round draws from a form that is longer by a character
    local, domain = F.substring_index(canon, "@", 1), F.substring_index(canon, "@", -1)
    host = F.regexp_replace(domain, r"\.[^.]*\z", "")
    host_stream = _stream(key, F.concat(F.lit("host|"), host), F.length(host))
    octets = [(_byte(stream, 2 * o) * 256 + _byte(stream, 2 * o + 1)) % 254 + 1 for o in range(4)]
    country, number = F.substring_index(canon, "|", 1), F.substring_index(canon, "|", -1)
    none = F.lit(0)
    longer = lambda x, letters="0123456789": F.concat(x, *[_pick(letters, _byte(stream, F.length(canon) + j)) for j in range(min(more, 24))])
    groups = F.array_join(F.transform(F.split(canon, ":"), lambda g: F.when(g == "", g).otherwise(F.rpad(g, F.least(F.lit(4), F.length(g) + more), F.lit("0")))), ":")
    groups = F.replace(groups, F.lit("::"), F.lit(":" + "0000:" * min(5, max(0, more - 3)) + ":"))
    options = {
        # later draws add characters, so that short parts cannot run out
        "email": F.concat(_like(local, stream, none), F.substring(F.sha2(F.concat_ws("|", F.lit(key), seed), 256), 1, max(0, turn - 3)), F.lit("@"), _like(host, host_stream, none), F.lit(".example")),
        "ip": F.concat(F.concat_ws(".", *octets), longer(F.lit(":" if more else ""))),
        "phone": longer(_like(number, stream, F.length(country))),
        "ssn": longer(_like(canon, stream, none)),
        "hex": _like(canon, stream, none, hexadecimal=True),
        "card": _card(canon, longer(_like(canon, stream, none))),
        "iban": _iban(canon, longer(_like(canon, stream, F.lit(2)))),
        "ipv6": _like(groups, stream, none, hexadecimal=True),
    }
    for script, syllables in SYLLABLES.items():
        for gender in "mf":
            said = F.concat(*[F.element_at(F.array(*map(F.lit, syllables)), _byte(stream, s) % len(syllables) + 1) for s in range(min(2 + turn, 12))])
            given = GIVEN[script, gender]
            options[f"given-{script}-{gender}"] = F.lower(F.element_at(F.array(*map(F.lit, given)), _byte(stream, 31) % len(given) + 1)) if not turn else F.concat(said, F.lit(ENDINGS[script, gender]))
            options["family-latin" if script == "latin" else f"family-{script}-{gender}"] = F.concat(said, F.lit("er" if script == "latin" else ENDINGS[script, gender]))
    return _case(kind, options)


def assign(parts: DataFrame, key: str, folder: str) -> DataFrame:
    """kind, canon, core: one surrogate per distinct part, different from all other surrogates and all real forms of its kind.

    Each round draws for the parts that have none. Of parts that drew the same, the smallest canonical form keeps it;
    draws that equal a real form or an earlier surrogate fall. Rounds go on until every part has its own. They end: from the
    fourth on, each draws from a form longer by a character (digits of numbers, a port of an address, hexadecimal digits and groups,
    syllables), so that soon less than half of the forms are real or taken, whatever the format; then each round serves more than
    half of the rest on average. The widest forms are 10^24 times as many as the format's own, 16^20 addresses, 16^12 names.
    """
    pending = parts.select("kind", "canon").distinct()
    real = stored(pending.select("kind", F.when(F.col("kind") == "phone", F.substring_index("canon", "|", -1)).otherwise(F.col("canon")).alias("core")).distinct(), folder, "real")
    taken, turn = None, 0
    while True:
        drawn = stored(pending.withColumn("core", draw(key, F.col("kind"), F.col("canon"), turn)), folder, f"drawn-{turn}")
        free = drawn.join(real, ["kind", "core"], "left_anti")
        if taken is not None:
            free = free.join(taken.select("kind", "core"), ["kind", "core"], "left_anti")
        won = stored(free.groupBy("kind", "core").agg(F.min("canon").alias("canon")).select("kind", "canon", "core"), folder, f"won-{turn}")
        taken = won if taken is None else taken.unionByName(won)
        pending = drawn.select("kind", "canon").join(won, ["kind", "canon"], "left_anti")
        if not pending.limit(1).count():
            return taken
        turn += 1


def _pour(entity: Column, core: Column) -> Column:
    """The characters of ``core`` in the places of the entity's letters and digits, in order."""
    step = lambda a, c: F.when(
        c.rlike("[0-9A-Za-z]"), F.struct(F.concat(a["out"], F.substring(core, a["i"] + 1, F.lit(1))).alias("out"), (a["i"] + 1).alias("i"))
    ).otherwise(F.struct(F.concat(a["out"], c).alias("out"), a["i"].alias("i")))
    # what a longer draw has more comes last
    return F.aggregate(F.split(entity, ""), F.struct(F.lit("").alias("out"), F.lit(0).alias("i")), step, lambda a: F.concat(a["out"], F.substring(core, a["i"] + 1, F.length(core))))


def render(entity: Column, kind: Column, cores: Column) -> Column:
    """The surrogate in the entity's format: separators, letter case and title as they were."""
    core, upper = cores[0], (F.upper(entity) == entity)
    title = F.regexp_extract(entity, rf"\A((?:{ANY_TITLE})\.? )", 1)
    words = F.array_join(F.zip_with(_name_words(entity), cores, lambda w, c: F.when((F.upper(w) == w) & (F.length(w) > 1), F.upper(c)).otherwise(F.initcap(c))), " ")
    formed = F.when(kind == "name", F.concat(title, words)).when(kind.isin("email", "hex", "ipv6"), F.when(upper, F.upper(core)).otherwise(core)).when(kind == "ip", core).otherwise(_pour(entity, core))
    return formed


def surrogate(docs: DataFrame, key: str, counted: str | None = None, folder: str | None = None) -> DataFrame:
    """``docs`` with every entity in ``text`` replaced; all other columns stay. ``counted`` names a column for their number.

    Null and empty texts, and texts without an entity, stay as they are (0 entities). Equal texts are searched once and
    come out equal. ``key`` is the secret: the same key gives the same surrogates in a later run, as far as no collision
    differs. Whole texts are searched, however long. An empty table stays empty. Entities are combined before each shuffle; the mentions of a text and the
    entities table are the only things gathered, and joins on them can be split where one text or entity is frequent.
    """
    folder = folder or shared_dir(docs.sparkSession)
    k, new_, hinted = fresh(docs, "text_md"), fresh(docs, "replacements"), F.coalesce(F.col("text").rlike(HINT), F.lit(False))
    md5 = F.md5(F.col("text").cast("binary"))
    searched = docs.where(hinted).select(md5.alias("k"), F.posexplode_outer(F.regexp_extract_all("text", F.lit(ANY), F.lit(0))).alias("pos", "entity"))
    mentions = stored(searched.where("entity IS NOT NULL").groupBy("k", "pos").agg(F.first("entity").alias("entity")), folder, "mentions")
    entities = mentions.select("entity").distinct().withColumn("kind", classify(F.col("entity")))
    entities = stored(entities.withColumn("parts", parts_of(F.col("entity"), F.col("kind"))), folder, "entities")
    pieces = entities.select("entity", F.posexplode_outer("parts").alias("i", "part")).select("entity", "i", "part.kind", "part.canon")
    mapped = pieces.join(assign(pieces, key, folder), ["kind", "canon"]).groupBy("entity").agg(F.array_sort(F.collect_list(F.struct("i", "core"))).alias("cores"))
    new = entities.join(mapped, "entity").select("entity", render(F.col("entity"), F.col("kind"), F.transform("cores", lambda c: c["core"])).alias("new"))
    replaced = mentions.join(stored(new, folder, "new"), "entity").groupBy(F.col("k").alias(k)).agg(F.array_sort(F.collect_list(F.struct("pos", "new"))).alias(new_))
    gaps = F.split("text", ANY, -1)
    rebuilt = F.array_join(F.zip_with(gaps, F.transform(new_, lambda n: n["new"]), lambda g, n: F.concat(g, F.coalesce(n, F.lit("")))), "")
    with_hint = docs.where(hinted).withColumn(k, md5).join(replaced, k, "left").drop(k)
    with_hint = with_hint.withColumn("text", F.when(F.col(new_).isNull(), F.col("text")).otherwise(rebuilt))
    with_hint = with_hint.withColumn(counted, F.coalesce(F.size(new_), F.lit(0)).cast("long")) if counted else with_hint
    rest = docs.where(~hinted)
    rest = rest.withColumn(counted, F.lit(0).cast("long")) if counted else rest
    return with_hint.select(*rest.columns).unionByName(rest)
