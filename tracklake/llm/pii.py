"""PII: detected entities get keyed surrogates of the same type, gender, script and format.

Only DataFrame functions are used. A text's entities are found by one pattern; each consists of one atom (an e-mail
address, a number, a secret) or two (given name and surname). An atom's surrogate is a function
of the key, its kind and its canonical form, so all mentions of one thing agree in every text and in every format:

* e-mail: local part and domain of the same shape, below a reserved name, the domain's surrogate depends on it alone;
* phone: country code and punctuation stay, the other digits change; card: same length and grouping, its check digit is
  right if it was right before; SSN and IBAN: same shape, an IBAN keeps its country and right check digits;
* address: public IPv4 stays public, private blocks stay so; IPv6 keeps its groups;
* secret: same alphabets and length; what names or marks it stays;
* names after a title or beginning with a common given name: the title stays, given names keep their gender, names keep
  their script.

Numbers, addresses, secrets go through a keyed permutation of all strings of their shape (four rounds that shift every
other character within its own alphabet by a digest of the rest), so within a shape surrogates are distinct by
construction and no letter or digit is left as it was but by chance. Collision check: over the distinct atoms of all
rows, surrogates that equal another atom's surrogate or any real atom are drawn again (the smallest atom of equal ones
keeps its own) until none is left. From the ``most_draws``-th draw on each is one character (or syllable) longer than the
one before (private addresses go on in 10.*, then get a port), so a format that is full ends as well, in a few rounds.

Distinct entities get their surrogates in a table of their own, so the work grows with them; mentions are joined to it
(those of hot entities by a broadcast of bounded size) and gathered by row.

Defined results: null and empty texts stay as they are; a text without entities stays as it is, to the byte; repeated
rows get equal results, whatever their ids; very long texts are nothing special; an empty table gives no rows; other
columns pass through whatever their names are, but with ``report`` columns of the report's names are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracklake.llm._session import checkpointed, hot_join, shuffle_partitions

#: Titles before names, by gender.
FEMALE = ("Mrs", "Ms", "Miss", "Frau", "Señora", "Sra", "Madame", "Mme", "Госпожа")
MALE = ("Mr", "Herr", "Señor", "Sr", "Monsieur", "Господин")
NEUTRAL = ("Dr", "Prof", "Professor", "Doctor")
#: Common given names, by gender.
GIVEN_FEMALE = "Alice Amelia Amy Angela Anna Anne Barbara Camille Carmen Catherine Charlotte Claire Claudia Elena Elisabeth Elizabeth Emily Emma Eva Hannah Helen Isabel Jane Jennifer Jessica Julia Karen Katharina Laura Linda Lisa Lucía Lucy Margaret Maria Marie María Mary Monika Natalia Olga Olivia Patricia Petra Rachel Sabine Sandra Sarah Sofia Sophie Susan Sylvie Ursula Анна Екатерина Елена Мария Наталья Ольга Татьяна".split()
GIVEN_MALE = "Alexander Andreas Andrew Antoine Antonio Carlos Charles Christian Christopher Daniel David Edward Francisco Frank François Frederick George Hans Henry Jacques James Jean Javier Johannes John Jonathan Jorge José Joseph Juan Jürgen Karl Klaus Louis Luis Manuel Markus Martin Michael Miguel Nicholas Oliver Patrick Paul Pedro Peter Philippe Pierre Richard Robert Samuel Stefan Stephen Thomas Walter William Wolfgang Александр Алексей Андрей Дмитрий Иван Михаил Сергей".split()
#: What names a secret, and how keys of well-known services begin.
SECRET_NAMES = "token|secret|password|passwd|passphrase|api[_-]?key|access[_-]?key|secret[_-]?key|private[_-]?key|client[_-]?secret"
KEY_MARKS = r"AKIA|ASIA|gh[pousr]_|github_pat_|glpat-|sk-|sk_live_|xox[abprs]-|AIza|eyJ"

_OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
_SECRET_HEAD = rf"(?i:{SECRET_NAMES})[\"']?\s{{0,4}}[:=]\s{{0,4}}[\"']?"
_PEM_HEAD = r"-----BEGIN [A-Z ]{0,24}PRIVATE KEY-----"
_HEX = r"(?:(?=[a-f]{0,31}[0-9])[0-9a-f]{32,}+|(?=[A-F]{0,31}[0-9])[0-9A-F]{32,}+)"
_NAME = r"\p{Lu}[\p{L}'’-]+"
_TITLE = rf"(?:(?:{'|'.join(FEMALE + MALE + NEUTRAL)})\.? )+"
_END = r"(?![\p{L}\p{N}])"
#: Alternatives begin where no letter or digit stands before, and take whole words at once, so matching is linear.
PATTERN = (
    r"(?<![\p{L}\p{N}])(?:"
    # what begins with a digit, a sign or a hexadecimal letter
    r"(?=[0-9+(:a-fA-F])(?:"
    rf"(?<![vV] )(?<!ersion )(?:{_OCTET}\.){{3}}{_OCTET}(?![\p{{L}}\p{{N}}]|\.\d)"
    rf"|(?=[0-9a-fA-F]{{0,4}}:[0-9a-fA-F:]*[0-9])(?:(?:[0-9a-fA-F]{{1,4}}:){{7}}[0-9a-fA-F]{{1,4}}|(?:[0-9a-fA-F]{{1,4}}:){{1,6}}(?::[0-9a-fA-F]{{1,4}}){{1,6}}|::[0-9a-fA-F]{{1,4}}(?::[0-9a-fA-F]{{1,4}}){{1,6}})(?![\p{{L}}\p{{N}}:])"
    rf"|{_HEX}{_END}"
    rf"|(?:\d{{13,19}}|\d{{4}}(?: \d{{4}}){{3}}|\d{{4}}(?:-\d{{4}}){{3}}){_END}"
    r"|\d{3}-\d{2}-\d{4}(?![\p{L}\p{N}-])"
    rf"|(?:\+\d{{1,3}}[ .-]?)?(?:\(\d{{2,4}}\)|\d{{3}})[ .-]?\d{{3}}[ .-]\d{{4}}{_END}"
    rf"|(?=\+(?:[ .()-]{{0,2}}\d){{8,15}}{_END})\+\d{{1,3}}(?:[ .-]?\(?\d{{1,4}}\)?){{2,7}}{_END}"
    rf"|0\d(?:[ .-]\d\d){{4}}{_END}|0\d{{2,4}}[ -]\d{{3,4}}[ -]\d{{3,4}}{_END}"
    rf"|(?=\d{{7,12}}{_END})(?<=(?i:tel|phone|mobile|fax|telefon|téléphone|teléfono)[.:]{{0,1}} {{0,2}})\d+"
    r")"
    r"|[\p{L}\p{N}._%+-]++@[\p{L}\p{N}-]+(?:\.[\p{L}\p{N}-]+)+"
    rf"|(?=[tspacTSPAC])(?i:{SECRET_NAMES})[\"']?\s{{0,4}}[:=]\s{{0,4}}(?:[\"'][^\"'\s]{{4,}}|(?=[^\s\"',;]*[0-9!@#$%^&*_=+/~])[^\s\"',;]{{6,}}|[A-Za-z0-9+/_-]{{8,}})"
    rf"|(?=[AgsxEe])(?:(?:AKIA|ASIA)[0-9A-Z]{{16}}|(?:gh[pousr]_|github_pat_)\w{{20,}}|glpat-[\w-]{{20,}}|(?:sk-|sk_live_)[\w-]{{20,}}|xox[abprs]-[\w-]{{10,}}|AIza[\w-]{{35}}|eyJ[\w-]{{8,}}(?:\.[\w-]{{4,}}){{1,2}}){_END}"
    rf"|{_PEM_HEAD}[A-Za-z0-9+/=\s]{{16,}}+"
    rf"|(?=\p{{Lu}})(?:[A-Z]{{2}}\d{{2}}(?: ?[A-Z0-9]{{4}}){{3,7}}(?: ?[A-Z0-9]{{1,3}})?{_END}|{_TITLE}{_NAME}(?: {_NAME})?|(?:{'|'.join(GIVEN_FEMALE + GIVEN_MALE)}) {_NAME})"
    r")"
)
#: Code points of letters and digits that change places with each other: first, last, step.
ALPHABETS = (
    (0x30, 0x39, 1), (0x61, 0x7A, 1), (0x41, 0x5A, 1),
    (0x430, 0x44F, 1), (0x410, 0x42F, 1), (0x450, 0x45F, 1), (0x400, 0x40F, 1),
    (0xDF, 0xF6, 1), (0xF8, 0xFF, 1), (0xC0, 0xD6, 1), (0xD8, 0xDE, 1), (0x100, 0x137, 2), (0x139, 0x148, 2), (0x14A, 0x177, 2),
    (0x3B1, 0x3C9, 1), (0x3AC, 0x3AF, 1), (0x3CC, 0x3CE, 1), (0x391, 0x3A1, 1), (0x3A3, 0x3A9, 1), (0x561, 0x586, 1), (0x531, 0x556, 1), (0x10D0, 0x10F0, 1),
    (0x5D0, 0x5EA, 1), (0x620, 0x63A, 1), (0x641, 0x64A, 1), (0x905, 0x939, 1), (0xE01, 0xE2E, 1),
    (0x3041, 0x3096, 1), (0x30A1, 0x30FA, 1), (0x4E00, 0x9FA5, 1), (0xAC00, 0xD7A3, 1),
)
_SYLLABLES = {"latin": ("ba be bi bo bra da de do dri fa fe fo ga go ka ke ki la le lo ma me mi mo na ne ni no ra re ro sa", "a", "n"), "cyrillic": ("ба бе би бо бра да де до дри фа фе фо га го ка ке ки ла ле ло ма ме ми мо на не ни но ра ре ро са", "а", "н")}
_HEX_DIGITS, _AS_LETTERS = "0123456789abcdef", "abcdefghijklmnop"
_PUBLIC = (*range(11, 100), *range(128, 169), *range(173, 192), *range(193, 224))


def _digest(key: str, *parts: Column) -> Column:
    """128 keyed hexadecimal digits."""
    return F.sha2(F.concat(F.lit(key), F.sha2(F.concat(F.lit(key), F.concat_ws("\x1f", *parts)), 512)), 512)


def _place(shown: str, base: str | int, step: int, size: int, value: str | int) -> str:
    """SQL of one character's place: as it stands, its alphabet's first code point, step and size, and its number there."""
    return f"named_struct('c', {shown}, 'b', cast({base} as int), 's', {step}, 'm', {size}, 'v', cast({value} as int))"


def _letters(value: str, hexed: str) -> Column:
    """The characters of a string as places in their alphabets; with ``hexed`` a to p are one, and all others stay."""
    lows, highs, steps = (f"array({', '.join(map(str, x))})" for x in zip(*sorted(ALPHABETS), strict=True))
    coded = f"transform(split({value}, ''), c -> named_struct('c', c, 'n', ascii(c), 'k', size(filter({lows}, l -> l <= ascii(c))) - 1))"
    low, high, step = (f"{x}[greatest(x.k, 0)]" for x in (lows, highs, steps))
    own = f"named_struct('c', x.c, 'b', {low} + (x.n - {low}) % {step}, 's', {step}, 'm', cast(({high} - {low} + 1) div {step} as int), 'v', cast((x.n - {low}) div {step} as int))"
    cases = (
        f"when {hexed} and x.n between 97 and 112 then {_place('x.c', 97, 1, 16, 'x.n - 97')} when {hexed} then {_place('x.c', 0, 1, 1, 0)} "
        f"when x.k >= 0 and x.n <= {high} then {own} when x.c rlike '^\\\\p{{L}}' then {_place('x.c', 97, 1, 26, 'x.n % 26')} else {_place('x.c', 0, 1, 1, 0)}"
    )
    return F.expr(f"case when length({value}) > 0 then transform({coded}, x -> case {cases} end) end")


def _octets(canon: str) -> Column:
    """The octets of an address; those that tell public from private stay (a public first octet changes among such)."""
    first, second = (f"cast(split({canon}, '[.]')[{k}] as int)" for k in (0, 1))
    public = f"array({', '.join(map(str, _PUBLIC))})"
    stays, any_ = _place("c", 0, 1, 1, 0), _place("c", 0, 1, 256, "c")
    head = f"when i = 0 and array_contains({public}, {first}) then {_place('c', 0, 1, len(_PUBLIC), f'array_position({public}, {first}) - 1')} when i = 0 then {stays}"
    next_ = f"when i = 1 and {first} = 192 and {second} = 168 then {stays} when i = 1 and {first} = 172 and {second} between 16 and 31 then {_place('c', 16, 1, 16, f'{second} - 16')}"
    return F.expr(f"transform(split({canon}, '[.]'), (c, i) -> case {head} {next_} else {any_} end)")


def _numbers(h: str, last: str | int) -> Column:
    """The first numbers (40 at most) under 4096 from a column of digits."""
    return F.expr(f"transform(sequence(0, least({last}, 39)), i -> cast(conv(substr({h}, i * 3 + 1, 3), 16, 10) as int))")


def _permuted(df: DataFrame, places: str, key: str, *tweak: Column) -> DataFrame:
    """Shifts the places of every other character by a digest of the others, in four rounds: a permutation of each shape."""
    number = "cast(conv(substr(_h, i div 2 % 40 * 3 + 1, 3), 16, 10) as int)"
    for r in range(4):
        rest = F.expr(f"array_join(transform(filter({places}, (x, i) -> i % 2 <> {r % 2}), x -> concat(x.v, ':', if(x.m = 1, x.c, ''))), ',')")
        df = df.withColumn("_h", F.when(F.size(places) > 0, _digest(key, F.lit(str(r)), *tweak, rest)))
        moved = f"named_struct('c', x.c, 'b', x.b, 's', x.s, 'm', x.m, 'v', cast((x.v + {number}) % x.m as int))"
        df = df.withColumn(places, F.expr(f"transform({places}, (x, i) -> if(i % 2 = {r % 2} and x.m > 1, {moved}, x))"))
    return df


def _spelt(places: str) -> Column:
    return F.expr(f"array_join(transform({places}, x -> if(x.m = 1, x.c, decode(unhex(lpad(hex(x.b + x.s * x.v), 4, '0')), 'UTF-16BE'))), '')")


def _luhn(digits: Column) -> Column:
    """Check sum modulo 10, 0 for a right number."""
    double = lambda d: F.when(d > 4, d * 2 - 9).otherwise(d * 2)
    value = F.transform(F.split(F.reverse(digits), ""), lambda c, i: F.when(i % 2 == 1, double(c.cast("int"))).otherwise(c.cast("int")))
    return F.aggregate(value, F.lit(0), lambda a, b: a + b) % 10


def _mod97(text: Column) -> Column:
    """The remainder of an IBAN's rearranged characters, letters counting 10 to 35."""
    value = lambda c: F.when(c.rlike("^[0-9]"), c.cast("int")).otherwise(F.ascii(c) - 55)
    return F.aggregate(F.transform(F.split(text, ""), value), F.lit(0), lambda a, b: F.when(b > 9, (a * 100 + b) % 97).otherwise((a * 10 + b) % 97))


def _word(script: str, parts: int, end: str = "") -> Column:
    syllables = _SYLLABLES[script][0].split()
    table = F.array(*[F.lit(s) for s in syllables])
    tail = F.array_join(F.transform(F.slice("_n", F.lit(parts + 1), F.col("_more")), lambda n: F.element_at(table, n % len(syllables) + 1)), "")
    return F.initcap(F.concat(*[F.element_at(table, F.element_at(F.col("_n"), k + 1) % len(syllables) + 1) for k in range(parts)], tail, F.lit(end)))


def _by_script(parts: int, end: int | None = None) -> Column:
    latin, cyrillic = (_word(s, parts, "" if end is None else _SYLLABLES[s][end]) for s in ("latin", "cyrillic"))
    canon = F.col("canon")
    return F.when(canon.rlike(r"\p{IsCyrillic}"), cyrillic).when(canon.rlike(r"\p{IsLatin}"), latin).otherwise(F.initcap("_shaped"))


def atom_surrogates(drawn: DataFrame, key: str, most_draws: int = 64) -> DataFrame:
    """Adds ``made``, the surrogate in canonical form, to rows of (kind, canon, attempt); longer from ``most_draws`` on."""
    kind, canon, more, attempt = F.col("kind"), F.col("canon"), F.col("_more"), F.col("attempt").cast("string")
    df = drawn.withColumn("_more", F.greatest(F.col("attempt") - (most_draws - 1), F.lit(0)))
    df = df.withColumn("_hexed", (kind == "ip6") | ((kind == "secret") & canon.rlike("^[0-9a-f]+$")))
    # the e-mail's domain without its last part and without the reserved name; its surrogate depends on it alone
    df = df.withColumn("_domain", F.when(kind == "email", F.substring_index(canon, "@", -1))).withColumn("_top", F.substring_index("_domain", ".", -1))
    df = df.withColumn("_inner", F.regexp_replace(F.expr("substr(_domain, 1, length(_domain) - length(_top) - 1)"), r"\.example$", ""))
    df = df.withColumn("_places", _letters("_inner", "false"))
    df = _permuted(df, "_places", key, F.lit("domain")).withColumn("_host", _spelt("_places"))
    given = (
        F.when(kind == "email", F.substring_index(canon, "@", 1)).when(kind == "card", F.expr("substr(canon, 1, length(canon) - 1)"))
        .when(kind == "iban", F.expr("substr(canon, 5)")).when(F.col("_hexed"), F.translate(canon, _HEX_DIGITS, _AS_LETTERS)).otherwise(canon)
    )
    df = df.withColumn("_given", F.concat(given, F.when(F.col("_hexed"), F.expr("repeat('a', _more)")).otherwise(F.expr("repeat('0', _more)"))))
    df = df.withColumn("_places", F.when(kind == "ip", _octets("canon")).otherwise(_letters("_given", "_hexed")))
    df = _permuted(df, "_places", key, kind, F.coalesce("_domain", F.lit("")), attempt).withColumn("_shaped", _spelt("_places"))
    df = df.withColumn("_h", _digest(key, F.lit("name"), kind, canon, attempt)).withColumn("_n", _numbers("_h", 39))
    df = df.withColumn("_email", F.concat("_shaped", F.lit("@"), "_host", F.when(F.col("_top").isin("com", "net", "org"), F.concat(F.lit(".example."), "_top")).otherwise(".example")))
    octets = F.expr(f"array_join(transform(_places, (x, i) -> case when x.m = 1 then x.c when i = 0 then string(array({', '.join(map(str, _PUBLIC))})[x.v]) else string(x.b + x.v) end), '.')")
    any_ = lambda k: (F.element_at(F.col("_n"), k) % 256).cast("string")
    private = canon.rlike(r"^(10|192\.168|172\.(1[6-9]|2\d|3[01]))\.") & (more > 0)
    port = F.when(more > 4, F.concat(F.lit(":"), (1024 + F.element_at(F.col("_n"), 5) * 15 + F.element_at(F.col("_n"), 6) % 15).cast("string"))).otherwise("")
    address = F.concat(F.when(private, F.concat_ws(".", F.lit("10"), any_(1), any_(2), any_(3))).otherwise(octets), port)
    last, number = F.expr("cast(right(canon, 1) as int)"), F.when(kind == "card", canon)
    df = df.withColumn("_right", (10 - _luhn(F.concat(F.when(kind == "card", F.col("_shaped")), F.lit("0")))) % 10)
    check = F.when(_luhn(number) == 0, F.col("_right")).when(last == F.col("_right"), (last + 1) % 10).otherwise(last)
    iban = F.when(kind == "iban", canon)
    right = _mod97(F.concat(F.expr("substr(canon, 5)"), F.expr("substr(canon, 1, 4)"))) == 1
    pair = F.when(iban.isNotNull() & right, F.lpad((98 - _mod97(F.concat("_shaped", F.expr("substr(canon, 1, 2)"), F.lit("00")))).cast("string"), 2, "0")).otherwise(F.expr("substr(canon, 3, 2)"))
    made = (
        F.when(kind == "email", F.col("_email"))
        .when(kind == "ip", address)
        .when(kind == "card", F.concat("_shaped", check.cast("string")))
        .when(F.col("_hexed"), F.translate("_shaped", _AS_LETTERS, _HEX_DIGITS))
        .when(kind == "iban", F.concat(F.expr("substr(canon, 1, 2)"), pair, "_shaped"))
        .when(kind == "surname", _by_script(4))
        .when(kind == "given_f", _by_script(3, 1))
        .when(kind == "given_m", _by_script(3, 2))
        .when(kind == "given_n", _by_script(4))
        .otherwise(F.col("_shaped"))
    )
    return df.select("kind", "canon", "attempt", made.alias("made"))


def with_kind(df: DataFrame) -> DataFrame:
    """Adds to entities (column ``e``) their kind, title, and one or two atoms (kind1, canon1, kind2, canon2)."""
    e, kind = F.col("e"), F.col("_kind")
    marked = rf"^(?:{_SECRET_HEAD}|{_PEM_HEAD}|(?:{KEY_MARKS}))"
    df = df.withColumn("_digits", F.regexp_replace(e, "[^0-9]", "")).withColumn(
        "_kind",
        F.when(e.rlike(rf"^(?:{_SECRET_HEAD}|{_PEM_HEAD})") | e.rlike(f"^{_HEX}$"), "secret")
        .when(e.contains("@"), "email")
        .when(e.rlike(rf"^(?:{KEY_MARKS})[\w.-]{{10,}}$") & ~e.contains(" "), "secret")
        .when(e.rlike(r"^\d{1,3}(\.\d{1,3}){3}$"), "ip")
        .when(e.rlike("^[0-9a-fA-F:]+$") & e.contains(":"), "ip6")
        .when(e.rlike("^[A-Z]{2}[0-9]"), "iban")
        .when(e.rlike(r"^\p{L}"), "name")
        .when(e.rlike(r"^\d{3}-\d{2}-\d{4}$"), "ssn")
        .when((F.length("_digits") >= 13) & e.rlike("^[0-9 -]+$"), "card")
        .otherwise("phone"),
    )
    df = df.withColumn("_title", F.when(kind == "name", F.regexp_extract(e, f"^(?:{_TITLE})?", 0)).when(kind == "secret", F.regexp_extract(e, f"{marked}?", 0)).otherwise(""))
    df = df.withColumn("_rest", F.expr("substr(e, length(_title) + 1)"))
    df = df.withColumn("_given", F.when((kind == "name") & F.col("_rest").contains(" "), F.substring_index("_rest", " ", 1)))
    # the country code ends at the first sign behind it, or ten digits before the end
    national = F.regexp_replace(F.when(e.rlike(r"^\+\d{1,3}[ .(-]"), F.regexp_replace(F.regexp_extract(e, r"^\+\d{1,3}(.*)$", 1), "[^0-9]", "")).otherwise(F.expr("right(_digits, 10)")), "^0", "")
    canon = (
        F.when(kind.isin("email", "ip6"), F.lower(e))
        .when(kind == "secret", F.col("_rest"))
        .when(kind == "ip", e)
        .when(kind == "iban", F.regexp_replace(e, " ", ""))
        .when(kind == "name", F.lower(F.substring_index("_rest", " ", -1)))
        .when(kind == "phone", F.when(F.length(national) > 0, national).otherwise(F.col("_digits")))
        .otherwise(F.col("_digits"))
    )
    titled = lambda titles: F.col("_title").rlike(rf"(^| )(?:{'|'.join(titles)})\.? ")
    gender = (
        F.when(F.col("_given").isin(*GIVEN_FEMALE), "given_f").when(F.col("_given").isin(*GIVEN_MALE), "given_m")
        .when(titled(FEMALE), "given_f").when(titled(MALE), "given_m").otherwise("given_n")
    )
    return df.withColumns({"kind1": F.when(kind == "name", "surname").otherwise(kind), "canon1": canon, "kind2": F.when(F.col("_given").isNotNull(), gender), "canon2": F.lower("_given")})


def atoms(entities: DataFrame) -> DataFrame:
    one, two = (entities.select(F.col(f"kind{k}").alias("kind"), F.col(f"canon{k}").alias("canon")) for k in (1, 2))
    return one.union(two.where("kind is not null")).distinct()


def _refilled(other: str) -> Column:
    """The entity with its letters and digits (all but ``other``), counted from the end, taken from ``made1``.

    What ``made1`` has beyond the length of ``canon1`` follows.
    """

    def change(c: Column, i: Column) -> Column:
        left = F.length(F.regexp_replace(F.substr(F.col("e"), i + 1, F.length("e")), other, ""))
        at = F.length("canon1") - left + 1
        return F.when(c.rlike(other) | (at < 1), c).otherwise(F.substr(F.col("made1"), F.greatest(at, F.lit(1)), F.lit(1)))

    return F.concat(F.array_join(F.transform(F.split("e", ""), change), ""), F.expr("substr(made1, length(canon1) + 1)"))


def dressed(entities: DataFrame) -> DataFrame:
    """(e, shown, kind): the entity's surrogate in its own format, from its atoms' surrogates made1 and made2."""
    e, kind = F.col("e"), F.col("_kind")
    df = entities.withColumn("_local", F.when(kind == "email", F.substring_index(e, "@", 1)).otherwise(""))
    local = F.array_join(F.transform(F.split("_local", ""), lambda c, i: F.when(c == F.lower(c), F.substr(F.col("made1"), i + 1, F.lit(1))).otherwise(F.upper(F.substr(F.col("made1"), i + 1, F.lit(1))))), "")
    shown = (
        F.when(kind == "email", F.concat(local, F.expr("substr(made1, length(_local) + 1)")))
        .when(kind == "secret", F.concat("_title", "made1"))
        .when(kind.isin("ip", "ip6"), F.col("made1"))
        .when(kind == "name", F.concat("_title", F.when(F.col("made2").isNull(), F.lit("")).otherwise(F.concat("made2", F.lit(" "))), "made1"))
        .when(kind == "iban", _refilled("[^A-Z0-9]"))
        .otherwise(_refilled("[^0-9]"))
    )
    return df.select("e", shown.alias("shown"), F.when(kind == "ip6", "ip").otherwise(kind).alias("kind"))


def surrogate_table(entities: DataFrame, key: str, most_draws: int = 3) -> DataFrame:
    """(e, shown, kind) of distinct entities ``e``, with collisions drawn again, longer from ``most_draws`` on, until there are none."""
    # a given number of partitions: the rows are small, but each is much work
    parts = shuffle_partitions(entities.sparkSession)
    typed = checkpointed(with_kind(entities.repartition(parts, "e")))
    real = checkpointed(atoms(typed).repartition(parts, "kind", "canon"))
    drawn = real.withColumn("attempt", F.lit(0))
    while True:
        drawn = checkpointed(atom_surrogates(drawn, key, most_draws))
        # of equal surrogates the oldest draw stays, then the smallest atom
        first = drawn.groupBy("kind", "made").agg(F.min(F.struct("attempt", "canon"))["canon"].alias("keeps"), F.count("*").alias("n")).where("n > 1").select("kind", "made", "keeps")
        lost = drawn.join(first, ["kind", "made"]).where("canon <> keeps").select("kind", "canon")
        lost = lost.union(drawn.join(real.select("kind", F.col("canon").alias("made")), ["kind", "made"], "left_semi").select("kind", "canon")).distinct()
        lost = checkpointed(lost.withColumn("again", F.lit(1)))
        if lost.isEmpty():
            break
        drawn = drawn.join(lost, ["kind", "canon"], "left").select("kind", "canon", (F.col("attempt") + F.coalesce("again", F.lit(0))).alias("attempt"))
    one, two = (drawn.select(F.struct("kind", "canon").alias(f"atom{k}"), F.col("made").alias(f"made{k}")) for k in (1, 2))
    typed = typed.withColumn("atom1", F.struct(F.col("kind1").alias("kind"), F.col("canon1").alias("canon"))).withColumn("atom2", F.when(F.col("kind2").isNotNull(), F.struct(F.col("kind2").alias("kind"), F.col("canon2").alias("canon"))))
    single = typed.join(one, "atom1")
    # a common given name belongs to very many names
    double = single.where("atom2 is not null")
    met = hot_join(double, two, "atom2", double.groupBy("atom2").agg(F.count("*").alias("n")))
    return dressed(met.unionByName(single.where("atom2 is null").withColumn("made2", F.lit(None).cast("string"))))


def with_surrogates(docs: DataFrame, key: str, text_col: str = "text", report: bool = False) -> DataFrame:
    """The rows with surrogates in the text; with ``report`` also n_entities and entity_kinds (sorted, comma-joined)."""
    more = ["n_entities", "entity_kinds"] if report else []
    columns = [c for c in docs.columns if c not in more]
    # the input's columns stand in one struct, so that no name of theirs meets one of these
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in columns]).alias("row"), docs[text_col].alias("text"))
    found = rows.withColumn("found", F.regexp_extract_all("text", F.lit(PATTERN), F.lit(0))).where(F.size("found") > 0)
    own = checkpointed(found.withColumn("number", F.monotonically_increasing_id()))
    mentions = own.select("number", F.posexplode("found").alias("at", "e"))
    entities = checkpointed(mentions.groupBy("e").agg(F.count("*").alias("n")))
    table = checkpointed(surrogate_table(entities.select("e"), key))
    shown = hot_join(mentions, table, "e", entities).groupBy("number").agg(F.array_sort(F.collect_list(F.struct("at", "shown", "kind"))).alias("shown"))
    parts = F.zip_with(F.split("text", PATTERN, -1), F.col("shown"), lambda p, x: F.concat(p, F.coalesce(x["shown"], F.lit(""))))
    kinds = F.array_join(F.array_sort(F.array_distinct(F.transform("shown", lambda x: x["kind"]))), ",")

    def finished(df: DataFrame, replaced: Column, n: Column, kinds: Column) -> DataFrame:
        values = dict(zip(more, (n.cast("long"), kinds), strict=False))
        return df.select(*[replaced.alias(c) if c == text_col else F.col("row")[c].alias(c) for c in columns], *[v.alias(k) for k, v in values.items()])

    changed = finished(own.join(shown, "number"), F.array_join(parts, ""), F.size("shown"), kinds)
    clean = rows.where(~F.coalesce(F.col("text").rlike(PATTERN), F.lit(False)))
    return changed.unionByName(finished(clean, F.col("text"), F.lit(0), F.lit("")))
