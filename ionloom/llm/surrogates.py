"""Surrogates for personal data and secrets.

Entities (mail and network addresses, phone, card, account and social-security numbers, keys and
passwords, names with a title) are found by one pattern. Each is reduced to a canonical form, so that
ways of writing the same thing agree, and gets one replacement of its kind for the whole corpus: drawn
from keyed hashes, with the same format, script, number class and, for names, gender. Replacements
are drawn in rounds: one that another entity holds or was given, or that occurs in the corpus
itself, is drawn again, so distinct entities stay distinct and none turns into a real one.

A name counts from its title on; the words of a document's titled names are also replaced where they
stand alone later or earlier in it, so that mentions without the title follow. Distinct mail domains get distinct
replacements, as the other entities do.

Not found: names that no title introduces anywhere in their document, postal addresses, dates of birth, numbers of passports, tax
and insurance other than the given ones, phone numbers of bare digits, IBANs in small letters, keys of
other makers without a label, mail addresses with a quoted name or spelled out ("at").

Only texts that can hold an entity are searched and only distinct entities take part in the rounds;
counts are combined before every shuffle, and joins are on entities with one row per entity on one
side. DataFrame functions only.

Defined cases: null text stays null with no entities; domains keep being shared: equal domains are
replaced alike, and end in a reserved name; equal rows stay equal; texts without entities are
returned as they are; columns other than id and text are not read.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ionloom.llm.common import KEY, key_columns
from ionloom.session import stage

KEY_TEXT = "surrogate key"
ROUNDS = 12
#: Rounds that keep an exchange reserved for fiction in phone numbers before all digits are drawn.
NARROW_ROUNDS = 4

OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
FEMALE = ("Mrs", "Ms", "Miss", "MRS", "MS", "MISS", "Frau", "Madame", "Mme", "Señora", "Sra", "Signora", "госпожа", "Госпожа")
MALE = ("Mr", "MR", "Herr", "Monsieur", "Señor", "Signor", "господин", "Господин")
TITLE = rf"\b(?:{'|'.join(sorted(FEMALE + MALE, key=len, reverse=True))})\b\.?"
LABEL = r"(?:password|passwd|pwd|passphrase|secret|token|api[_-]?key|access[_-]?key|auth[_-]?key|client[_-]?secret)"
MAIL = r"\p{L}\p{M}\p{N}._%+-"
LABELS = r"[\p{L}\p{M}\p{N}-]{1,63}"
#: Letters of one alphabet, so that text written on without a blank isn't taken for the ending.
ENDING = r"(?:xn--[A-Za-z0-9-]{1,59}|[A-Za-z]{2,24}|[\p{L}\p{M}]{2,24})"
IPV4 = rf"{OCTET}(?:\.{OCTET}){{3}}"
HEX = "[0-9A-Fa-f]{1,4}"
KEYS = r"(?:AKIA|ASIA|gh[opsu]_|sk-|xox[abprs]-|AIza)"
#: Kinds in order of precedence; the first that matches at a place wins. Each begins with a test of the next or the
#: last character, which rules out nearly all places before the search for labels, titles or long runs begins.
PATTERNS = {
    "secret": rf"(?<=[=:\"' \t])(?<=[=:][ \t]{{0,3}}[\"']{{0,1}})"
    rf"(?<=(?i:{LABEL})[\"']{{0,1}}[ \t]{{0,3}}[=:][ \t]{{0,3}}[\"']{{0,1}})[^\s\"'`,;<>(){{}}\[\]]{{6,}}",
    "email": rf"(?<![{MAIL}])[{MAIL}]{{1,256}}+@{LABELS}(?:\.{LABELS}){{0,5}}\.{ENDING}",
    "key": r"(?=[Agsx])\b(?:(?:AKIA|ASIA)[0-9A-Z]{16}\b|gh[opsu]_[A-Za-z0-9]{36,255}\b|sk-[A-Za-z0-9_-]{20,200}|xox[abprs]-[A-Za-z0-9-]{10,200}"
    r"|AIza[0-9A-Za-z_-]{35})",
    "iban": r"(?=[A-Z])\b[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?\b",
    "ssn": r"(?=\d)(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-])",
    "ipv6": rf"(?=[0-9A-Fa-f:])(?<![\w:.])(?=[0-9A-Fa-f:]*\d)(?:(?:{HEX}:){{7}}{HEX}|(?:{HEX}:){{6}}{IPV4}"
    rf"|(?:{HEX}(?::{HEX}){{0,6}})?::(?:(?:{HEX}:){{0,5}}(?:{IPV4}|{HEX}))?)(?![\w:]|\.\d)",
    "ip": rf"(?=\d)(?<![\w.]){IPV4}(?![\w]|\.\d)",
    "card": r"(?=\d)(?<![\w.+-])\d(?:[ -]?\d){12,18}(?![\w]|-\d)",
    "phone": r"(?=[+(\d])(?:(?<![\w.])(?:\+\d{1,3}[ .-]?|1[ .-])?\(\d{2,4}\)[ .-]?\d{3,4}[ .-]?\d{3,4}(?!\w)|(?<![\w.])\+\d{1,3}(?:[ .-]?\d{2,4}){2,5}(?!\w)"
    r"|(?<![\w.-])(?:1[ .-])?(?:\d{3}[.-]\d{3}[.-]\d{4}|[2-9]\d{2} [2-9]\d{2} \d{4})(?![\w-]))",
    "name": rf"(?=[MHFSгГ]){TITLE}\s\p{{Lu}}[\p{{L}}'’-]{{1,40}}(?:\s\p{{Lu}}[\p{{L}}'’-]{{1,40}}){{0,2}}",
}
ANY = "|".join(f"(?:{p})" for p in PATTERNS.values())
#: Every entity holds one of these.
HINT = rf"[0-9@=:]|{KEYS}|[MHFSгГ](?:rs?|s|RS?|S|ISS|me|iss|adame|onsieur|err|rau|eñora?|ra|ignora?|осподин|оспожа)\b"
DIGITS = ("phone", "card", "ssn")
CONSONANTS = {"latin": "bdfghjklmnprstvz", "cyrillic": "бвгджзклмнпрстфх"}
VOWELS = {"latin": "aeiou", "cyrillic": "аеиоу"}


def kind_of(value: Column) -> Column:
    """A kind by the whole value; a secret, known by its label in the text, is what fits no other."""
    result = F.lit("secret")
    for kind in reversed([k for k in PATTERNS if k != "secret"]):
        result = F.when(value.rlike(f"^(?:{PATTERNS[kind]})$"), F.lit(kind)).otherwise(result)
    return result


def eight_groups(value: Column) -> Column:
    """An IPv6 address in lower case with all its groups, no leading zeros and no IPv4 tail."""
    octet = F.split(F.regexp_extract(value, rf"{IPV4}$", 0), r"\.")
    pair = lambda i: F.hex(F.get(octet, F.lit(i)).cast("int") * 256 + F.get(octet, F.lit(i + 1)).cast("int"))
    tail = F.when(value.contains("."), F.concat(pair(0), F.lit(":"), pair(2))).otherwise("")
    plain = F.lower(F.concat(F.regexp_replace(value, rf"(?<=:){IPV4}$", ""), tail))
    parts = lambda text: F.array_remove(F.split(text, ":"), "")
    left, right = parts(F.substring_index(plain, "::", 1)), parts(F.substring_index(plain, "::", -1))
    gap = F.array_repeat(F.lit("0"), F.lit(8) - F.size(left) - F.size(right))
    groups = F.when(plain.contains("::"), F.concat(left, gap, right)).otherwise(parts(plain))
    return F.array_join(F.transform(groups, lambda g: F.regexp_replace(g, "^0+(?=.)", "")), ":")


def canonical(kind: Column, value: Column) -> Column:
    digits = F.regexp_replace(value, r"\D", "")
    words = F.lower(F.regexp_replace(value, rf"^{TITLE}\s", ""))
    sex = F.when(value.rlike(rf"^(?:{'|'.join(FEMALE)})\b"), "f ").otherwise("m ")
    return (
        F.when(kind.isin(*DIGITS), digits).when(kind == "email", F.lower(value)).when(kind == "ipv6", eight_groups(value))
        .when(kind == "iban", F.regexp_replace(value, " ", "")).when(kind == "name", F.concat(sex, words)).otherwise(value)
    )


def draw(n: Column | int, *parts: Column) -> Column:
    """A number below n from the keyed hash of the parts."""
    h = F.sha2(F.concat_ws("\x1f", F.lit(KEY_TEXT), *parts), 256)
    return F.pmod(F.conv(F.substring(h, 1, 12), 16, 10).cast("long"), n if isinstance(n, Column) else F.lit(n))


def pick(letters: str, *parts: Column) -> Column:
    return F.substring(F.lit(letters), (draw(len(letters), *parts) + 1).cast("int"), F.lit(1))


def same_class(text: Column, purpose: str, salt: Column) -> Column:
    """Each letter or digit replaced by one of its class; text of hex digits only stays hex."""
    lower, upper, digit = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
    hexed = text.rlike("^[0-9a-f]*$") & text.rlike("[a-f]")

    def one(c: Column, i: Column) -> Column:
        parts = (F.lit(purpose), salt, text, i.cast("string"))
        return (
            F.when(hexed, pick("0123456789abcdef", *parts)).when(c.rlike("[0-9]"), pick(digit, *parts))
            .when(c.rlike("[a-z]"), pick(lower, *parts)).when(c.rlike("[A-Z]"), pick(upper, *parts))
            .when(c.rlike(r"\p{IsCyrillic}"), pick("абвгдежзиклмнопрстуфхцчшэюя", *parts))
            .when(c.rlike(r"\p{Lu}"), pick(upper, *parts)).when(c.rlike(r"\p{L}"), pick(lower, *parts)).when(c.rlike(r"\p{N}"), pick(digit, *parts)).otherwise(c)
        )

    return F.array_join(F.transform(F.split(text, ""), one), "")


def check_digit(body: Column) -> Column:
    """Last digit that makes a number pass the Luhn test."""
    n = F.length(body)

    def weigh(c: Column, i: Column) -> Column:
        d = c.cast("int") * F.when((n - i) % 2 == 1, 2).otherwise(1)
        return F.when(d > 9, d - 9).otherwise(d)

    total = F.aggregate(F.transform(F.filter(F.split(body, ""), lambda c: c != ""), weigh), F.lit(0), lambda a, x: a + x)
    return ((10 - total % 10) % 10).cast("string")


def luhn(number: Column) -> Column:
    return check_digit(F.substring(number, F.lit(1), F.length(number) - 1)) == F.substring(number, -1, 1)


def iban_checked(text: Column) -> Column:
    """The text with the check digits that its letters and digits call for."""
    moved = F.concat(F.substring(text, F.lit(5), F.length(text)), F.substring(text, 1, 2), F.lit("00"))

    def step(rest: Column, c: Column) -> Column:
        letter = c.rlike("[A-Z]")
        value = F.when(letter, F.ascii(c) - 55).otherwise(c.cast("int"))
        return (rest * F.when(letter, 100).otherwise(10) + value) % 97

    rest = F.aggregate(F.filter(F.split(moved, ""), lambda c: c != ""), F.lit(0), step)
    return F.concat(F.substring(text, 1, 2), F.lpad((98 - rest).cast("string"), 2, "0"), F.substring(text, F.lit(5), F.length(text)))


def replacement(kind: Column, canon: Column, turn: int) -> Column:
    """The replacement of a canonical form that round `turn` proposes."""
    salt = F.lit(str(turn))
    mapped = same_class(canon, "chars", salt)

    def digit(low: int, high: int, *parts: Column) -> Column:
        return (draw(high - low + 1, F.lit("digit"), salt, canon, *parts) + low).cast("string")

    # Phone: country code and a plausible area; a fictional exchange is kept while that leaves room.
    american = canon.rlike("^1?[2-9][0-9]{9}$") & F.length(canon).isin(10, 11)
    code = F.when(F.length(canon) == 11, "1").otherwise("")
    line = F.substring(mapped, -4, 4)
    fiction = (F.substring(canon, -7, 3) == "555") & F.lit(turn < NARROW_ROUNDS)
    exchange = F.when(fiction, "555").otherwise(F.concat(digit(2, 9, F.lit("x")), F.substring(mapped, -6, 2)))
    us_phone = F.concat(code, digit(2, 9, F.lit("a")), F.substring(mapped, -9, 2), exchange, line)
    phone = F.when(american, us_phone).otherwise(F.concat(F.substring(canon, 1, 2), F.substring(mapped, F.lit(3), F.length(canon))))
    # Card: the network's first digit, and a valid check digit where there was one.
    body = F.concat(F.substring(canon, 1, 1), F.substring(mapped, F.lit(2), F.length(canon) - 2))
    card = F.concat(body, F.when(luhn(canon), check_digit(body)).otherwise(F.substring(mapped, -1, 1)))
    ssn = F.concat(digit(1, 5, F.lit("s")), F.substring(mapped, 2, 2), digit(1, 9, F.lit("t")), F.substring(mapped, 5, 1), digit(1, 9, F.lit("u")), F.substring(mapped, 7, 3))
    # Network address: private ranges stay private, public ones public.
    part = F.split(canon, r"\.")
    octet = lambda i, low, high: digit(low, high, F.lit(f"o{i}"))
    wide = F.concat_ws(".", octet(2, 0, 255), octet(3, 1, 254))
    ip = (
        F.when(part[0] == "10", F.concat_ws(".", F.lit("10"), octet(1, 0, 255), wide))
        .when((part[0] == "192") & (part[1] == "168"), F.concat(F.lit("192.168."), wide))
        .when((part[0] == "172") & part[1].cast("int").between(16, 31), F.concat_ws(".", F.lit("172"), octet(1, 16, 31), wide))
        .when(part[0] == "127", F.concat_ws(".", F.lit("127"), octet(1, 0, 255), wide))
        .otherwise(F.concat_ws(".", octet(0, 11, 99), octet(1, 0, 255), wide))
    )
    # Mail: letters for letters before the @, under the domain as it is; `assigned` puts the domain's own replacement there.
    local, domain = F.substring_index(canon, "@", 1), F.substring_index(canon, "@", -1)
    mail = F.concat_ws("@", same_class(local, "local", F.concat(salt, domain)), domain)
    # Domains: letters for letters of the host, by the whole domain, under a reserved name; names without a host of their
    # own, and all in later rounds, get letters more.
    host = F.regexp_replace(canon, r"(?:\.?example)?\.(?:xn--[a-z0-9-]+|[\p{L}\p{M}]+)$", "")
    ending = F.when(canon.rlike(r"\.(?:com|net|org)$"), F.substring_index(canon, ".", -1)).otherwise("com")
    more = F.concat(*(pick("bcdfghjklmnpqrstvwxz", F.lit(f"more{i}"), salt, canon) for i in range(5)))
    short = (host == "") | F.lit(turn >= NARROW_ROUNDS)
    label = F.concat(same_class(host, "host", F.concat(salt, canon)), F.when(short, more).otherwise(""))
    site = F.concat_ws(".", label, F.lit("example"), ending)
    key = F.concat(F.regexp_extract(canon, f"^{KEYS}", 0), same_class(F.regexp_replace(canon, f"^{KEYS}", ""), "key", salt))
    # IPv6: link-local and private prefixes stay, others get the one for documentation.
    h = F.sha2(F.concat_ws("\x1f", F.lit(KEY_TEXT), F.lit("ipv6"), salt, canon), 256)
    group = lambda i: F.regexp_replace(F.substring(h, 4 * i + 1, 4), "^0+(?=.)", "")
    first = F.regexp_extract(canon, "^f[cd][0-9a-f]{2}(?=:)|^fe[89ab][0-9a-f](?=:)", 0)
    ipv6 = F.concat_ws(":", F.when(first != "", F.concat(first, F.lit(":"), group(0))).otherwise("2001:db8"), *(group(i) for i in range(1, 7)))
    iban = iban_checked(F.concat(F.substring(canon, 1, 4), F.substring(mapped, F.lit(5), F.length(canon))))
    # Names: word by word, so that a shared surname stays shared; women's end in a vowel, men's in a consonant.
    sex, words = F.substring(canon, 1, 2), F.split(F.substring(canon, F.lit(3), F.length(canon)), r"\s")

    def name(word: Column) -> Column:
        def spell(script: str) -> Column:
            syllable = lambda k: F.concat(pick(CONSONANTS[script], word, salt, F.lit(f"c{k}")), pick(VOWELS[script], word, salt, F.lit(f"v{k}")))
            end = F.when(sex == "f ", F.lit(VOWELS[script][0])).otherwise(pick(CONSONANTS[script], word, salt, F.lit("end")))
            return F.concat(syllable(0), syllable(1), syllable(2), pick(CONSONANTS[script], word, salt, F.lit("last")), end)

        return F.when(word.rlike(r"\p{IsCyrillic}"), spell("cyrillic")).otherwise(spell("latin"))

    named = F.concat(sex, F.array_join(F.transform(words, name), " "))
    return (
        F.when(kind == "phone", phone).when(kind == "card", card).when(kind == "ssn", ssn).when(kind == "ip", ip).when(kind == "ipv6", ipv6).when(kind == "email", mail)
        .when(kind == "domain", site).when(kind == "key", key).when(kind == "iban", iban).when(kind == "name", named).otherwise(mapped)
    )


def rendered(kind: Column, value: Column, canon: Column) -> Column:
    """A canonical replacement written the way the entity was."""

    def place(a: Column, c: Column) -> Column:
        mine = c.rlike("[0-9]") | ((kind == "iban") & (c != " "))
        return F.struct(
            F.concat(a["out"], F.when(mine, F.substring(canon, a["i"], F.lit(1))).otherwise(c)).alias("out"),
            (a["i"] + F.when(mine, 1).otherwise(0)).alias("i"),
        )

    start = F.struct(F.lit("").alias("out"), F.lit(1).alias("i"))
    placed = F.aggregate(F.split(value, ""), start, place, lambda a: a["out"])
    titled = F.concat(F.regexp_extract(value, rf"^{TITLE}\s", 0), F.initcap(F.substring(canon, F.lit(3), F.length(canon))))
    return F.when(kind.isin(*DIGITS, "iban"), placed).when(kind == "name", titled).otherwise(canon)


def assigned(entities: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """(kind, canon, new) for distinct (kind, canon): replacements no two of which are equal, nor equal to an entity."""
    addresses = entities.filter("kind = 'email'")
    domains = addresses.select(F.lit("domain").alias("kind"), F.substring_index("canon", "@", -1).alias("canon"))
    originals = stage(entities.select("kind", "canon").unionByName(domains).distinct(), "canonical")
    tasks = 2 * entities.sparkSession.sparkContext.defaultParallelism
    pending, given = originals, []
    for turn in range(rounds):
        # Few bytes but much work each: more tasks than their size would give.
        spread = pending.repartition(tasks, "canon")
        proposed = stage(spread.withColumn("new", replacement(F.col("kind"), F.col("canon"), turn)), "proposed")
        taken = [originals.select("kind", F.col("canon").alias("new")), *(g.select("kind", "new") for g in given)]
        free = proposed.join(reduce(DataFrame.unionByName, taken), ["kind", "new"], "left_anti")
        winners = free.groupBy("kind", "new").agg(F.min("canon").alias("canon"))
        accepted = stage(winners.select("kind", "canon", "new"), "accepted")
        given.append(accepted)
        pending = stage(proposed.join(accepted, ["kind", "canon"], "left_anti").select("kind", "canon"), "pending")
        if pending.isEmpty():
            return with_domains(reduce(DataFrame.unionByName, given))
    raise ValueError(f"{pending.count()} entities have no distinct replacement after {rounds} rounds")


def with_domains(pairs: DataFrame) -> DataFrame:
    """Mail addresses under the replacement of their domain. Distinct addresses stay distinct, as distinct domains do."""
    domains = pairs.filter("kind = 'domain'").select(F.col("canon").alias("domain"), F.col("new").alias("site"))
    mails = pairs.filter("kind = 'email'").withColumn("domain", F.substring_index("canon", "@", -1)).join(domains, "domain")
    moved = mails.select("kind", "canon", F.concat_ws("@", F.substring_index("new", "@", 1), "site").alias("new"))
    return pairs.filter("kind not in ('domain', 'email')").unionByName(moved)


def later_mentions(segments: Column, names: Column) -> Column:
    """The segments with every word of the document's names, where it stands alone with its capital, replaced as in the name."""
    edge = r"(?<![\p{L}\p{M}'’-])", r"(?![\p{L}\p{M}-])"

    def one(segment: Column) -> Column:
        return F.aggregate(names, segment, lambda text, n: F.regexp_replace(text, F.concat(F.lit(edge[0]), n["old"], F.lit(edge[1])), n["new"]))

    return F.transform(segments, one)


def name_words(value: Column, new: Column) -> Column:
    """(old, new) of the words of a name and of its replacement, without their title; short words may mean other things."""
    bare = lambda text: F.split(F.regexp_replace(text, rf"^{TITLE}\s", ""), r"\s")
    pairs = F.zip_with(bare(value), bare(new), lambda a, b: F.struct(a.alias("old"), b.alias("new")))
    return F.filter(pairs, lambda p: (F.length(p["old"]) >= 3) & p["new"].isNotNull())


def found_entities(texts: DataFrame) -> DataFrame:
    """(keys, at, value) in text order."""
    return texts.select(*KEY, F.posexplode(F.regexp_extract_all("text", F.lit(ANY), F.lit(0))).alias("at", "value"))


def replace_entities(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", rounds: int = ROUNDS) -> DataFrame:
    """id, text with replacements, n_entities, kinds (sorted, comma-joined) and changed of every row."""
    texts = docs.select(F.col(id_column), F.col(text_column).alias("text"), *key_columns(id_column, text_column))
    hinted = F.coalesce(F.col("text").rlike(HINT), F.lit(False))
    some = texts.filter(hinted)
    found = stage(found_entities(some), "entities")
    values = found.select("value").distinct().withColumn("kind", kind_of(F.col("value")))
    values = stage(values.withColumn("canon", canonical(F.col("kind"), F.col("value"))), "values")
    written = values.join(assigned(values, rounds), ["kind", "canon"])
    written = stage(written.select("value", "kind", rendered(F.col("kind"), F.col("value"), F.col("new")).alias("new")), "written")
    by_text = found.join(written, "value").groupBy(*KEY).agg(
        F.sort_array(F.collect_set(F.struct("at", "new"))).alias("new"), F.sort_array(F.collect_set("kind")).alias("kinds"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.when(F.col("kind") == "name", name_words(F.col("value"), F.col("new"))))))).alias("names"),
    )
    joined = some.join(by_text, KEY, "left")
    plain_between = F.split("text", ANY, -1)
    between = F.when(F.size("names") > 0, later_mentions(plain_between, F.col("names"))).otherwise(plain_between)
    woven = F.array_join(F.flatten(F.zip_with(between, F.col("new.new"), lambda a, b: F.array(a, F.coalesce(b, F.lit(""))))), "")
    touched = joined.select(
        id_column, F.when(F.col("new").isNull(), F.col("text")).otherwise(woven).alias("text"),
        F.coalesce(F.size("new"), F.lit(0)).alias("n"), F.coalesce(F.array_join("kinds", ","), F.lit("")).alias("kinds"),
    )
    plain = texts.filter(~hinted).select(id_column, "text", F.lit(0).alias("n"), F.lit("").alias("kinds"))
    both = touched.unionByName(plain)
    n = F.greatest(F.col("n"), F.lit(0)).cast("long")
    return both.select(id_column, "text", n.alias("n_entities"), "kinds", (n > 0).alias("changed"))
