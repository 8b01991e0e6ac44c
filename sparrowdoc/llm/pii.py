"""Personal data in texts: candidates by patterns, boosted trees over their format and context, calibrated thresholds.

All of it is column expressions. Four base patterns find what is certain; wider generators propose further spans, which may
overlap, and the trees decide on these. The trees are fitted on labelled candidates written by rule (no person's data), and
become one CASE expression a tree.

Positions: a pattern's matches are those between the pieces that splitting by it leaves, so that the lengths of both, added
up, are the offsets, in code points.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

KINDS = ("email", "ip", "card", "phone")
#: What the trees decide on besides: keys and passwords, which have no base pattern.
ALL = (*KINDS, "secret")

#: The base patterns, for Java. A match begins where the one before ended or where its first run begins, and runs are taken
#: whole; so they find what their plain forms find, without rescanning a long run from each of its characters.
BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?:\G|(?<![0-9]))[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}

#: Further candidates: spelt-out addresses, addresses of eight groups, long digit groups, numbers without a country code; and
#: values given to names of secrets, and strings in the forms of well-known keys.
WIDE = {
    "email": r"[A-Za-z0-9._%+-]{1,64}+ ?(?:\(at\)|\[at\]|@) ?[A-Za-z0-9-]{1,63}+(?: ?(?:\(dot\)|\[dot\]|\.) ?[A-Za-z0-9-]{1,63}+){1,6}",
    "ip": r"(?<![0-9A-Za-z:])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![0-9A-Za-z:])",
    "card": r"(?<![0-9])[0-9]{4}(?:[ -]?[0-9]{4}){2}[ -]?[0-9]{1,7}(?![0-9])",
    "phone": r"(?<![0-9A-Za-z+.])\(?[0-9]{2,4}\)?[ ./-][0-9]{3,4}[ .-]?[0-9]{3,6}(?![0-9A-Za-z])",
    "secret": r"(?i:password|passwd|pwd|secret|token|api[_-]?key|access[_-]?key|private[_-]?key)\"? ?[=:] ?[\"']?[A-Za-z0-9+/_.~!@#$%^&*-]{8,256}+[\"']?"
    r"|(?<![A-Za-z0-9])(?:(?:AKIA|ASIA)[A-Z0-9]{16}|gh[pousr]_[A-Za-z0-9]{30,80}|xox[abprs]-[A-Za-z0-9-]{10,80}|sk-[A-Za-z0-9_-]{20,120}|eyJ[A-Za-z0-9_-]{10,400}\.[A-Za-z0-9_-]{10,800}\.[A-Za-z0-9_-]{10,200})(?![A-Za-z0-9])"
    r"|-----BEGIN [A-Z ]{0,20}PRIVATE KEY-----[A-Za-z0-9+/=\s]{0,8000}+(?:-----END [A-Z ]{0,20}PRIVATE KEY-----)?",
}
#: What a text must hold for a kind's wide pattern to be tried.
NEEDS = {"email": r"@|[\[(]at[\])]", "ip": "[0-9A-Fa-f]:[0-9A-Fa-f]", "card": "[0-9]{2}", "phone": "[0-9]{2}", "secret": r"(?i)passw|pwd|secret|token|key|AKIA|ASIA|gh[pousr]_|xox|sk-|eyJ"}

#: Words before a number that speak for a kind; fixed lists.
SPEAKS = {
    "email": r"(?i)(e-?mail|mailto|contact|correo|courriel|adresse)\W*$",
    "ip": r"(?i)\b(ip|ipv6|host|server|address)\W*$",
    "card": r"(?i)(card|visa|mastercard|carte|karte|tarjeta|credit)( (no|nr|number)\.?)?\W*$",
    "phone": r"(?i)(tel|phone|call|mobile|fax|fon|rufnummer|móvil|teléfono|téléphone|tél)\W*$",
    "secret": r"(?i)(export|set|env|config|login|credentials?|bearer)\W*$",
}
AGAINST = r"(?i)(order|version|isbn|page|pages|from|between|id|no\.|nr\.|build|serial|invoice|code|chapter|key|token|hash)\W*$"
CONTEXT = 24
FEATURES = ("kind", "digits", "groups", "speaks", "against", "luhn", "marks", "attached", "capitals", "letters")


def digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def luhn(d: Column) -> Column:
    """Does a string of digits pass the check sum: every second digit from the right doubled."""

    def value(i: Column) -> Column:
        v = F.substring(d, -i, F.lit(1)).cast("int")
        twice = 2 * v
        return F.when(i % 2 == 1, v).when(twice > 9, twice - 9).otherwise(twice)

    total = F.aggregate(F.sequence(F.lit(1), F.length(d)), F.lit(0), lambda s, i: s + value(i))
    return (F.length(d) > 0) & (F.when(F.length(d) > 0, total).otherwise(1) % 10 == 0)


def passes(kind: str, m: Column) -> Column:
    """The conditions on a base match."""
    n = F.length(digits(m))
    if kind == "ip":
        part = r"0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])"
        return m.rlike(rf"^{part}(?:\.{part}){{3}}$")
    if kind == "card":
        return F.when((n >= 14) & (n <= 19), luhn(digits(m))).otherwise(F.lit(False))
    if kind == "phone":
        return (n >= 10) & (n <= 15)
    return F.lit(True)


SPAN = "array<struct<start:int,kind:int,end:int>>"


#: Matches that are gathered in one array before it is put to the others, so that a text with very many costs little more each.
GATHERED = 64


def located(text: Column, pattern: str, keep, made, kind: str) -> Column:
    """The matches of a pattern that keep() accepts, as made(start, end, match, text before)."""
    zipped = F.arrays_zip(F.split(text, pattern, -1).alias("p"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("m"))

    def step(acc: Column, x: Column) -> Column:
        piece, m = F.coalesce(x["p"], F.lit("")), x["m"]
        a = acc["at"] + F.length(piece)
        b = a + F.coalesce(F.length(m), F.lit(0))
        ok = m.isNotNull() & keep(m)
        return F.struct(b.alias("at"), F.when(ok, F.concat(acc["out"], F.array(made(a, b, m, piece)))).otherwise(acc["out"]).alias("out"))

    def some(acc: Column, i: Column) -> Column:
        found = F.aggregate(F.slice(zipped, i * GATHERED + 1, F.lit(GATHERED)), F.struct(acc["at"].alias("at"), none(kind).alias("out")), step)
        return F.aggregate(F.array(found), acc, lambda acc, f: F.struct(f["at"].alias("at"), F.concat(acc["out"], F.array(f["out"])).alias("out")))

    start = F.struct(F.lit(0).alias("at"), none(f"array<{kind}>").alias("out"))
    few = F.aggregate(zipped, F.struct(F.lit(0).alias("at"), none(kind).alias("out")), step, lambda acc: acc["out"])
    many = F.flatten(F.aggregate(F.sequence(F.lit(0), F.floor((F.size(zipped) - 1) / GATHERED).cast("int")), start, some, lambda acc: acc["out"]))
    return F.when(F.size(zipped) <= GATHERED, few).otherwise(many)


def none(kind: str) -> Column:
    return F.expr(f"cast(array() as {kind})")


def base_spans(text: Column) -> Column:
    """Base spans of a text that has any of the characters they need."""
    parts = []
    for i, kind in enumerate(KINDS):
        needs = text.contains("@") if kind == "email" else text.contains("+") if kind == "phone" else text.rlike("[0-9]")
        found = located(text, BASE[kind], lambda m, kind=kind: passes(kind, m), lambda a, b, m, p, i=i: F.struct(a.alias("start"), F.lit(i).alias("kind"), b.alias("end")), SPAN)
        parts.append(F.when(needs, found).otherwise(none(SPAN)))
    return F.array_sort(F.concat(*parts))


# -- candidates and their features ----------------------------------------------------------------------------------------

CANDIDATE = "array<struct<start:int,end:int,f:array<int>>>"


def measured(kind: int, m: Column, before: Column) -> Column:
    """FEATURES of a candidate, small whole numbers. before: the text since the match before it."""
    d, near = digits(m), F.right(before, F.lit(CONTEXT))
    flag = lambda c: c.cast("int")
    groups = F.size(F.regexp_extract_all(m, F.lit("[0-9]+"), F.lit(0)))
    check = F.when((F.length(d) >= 12) & (F.length(d) <= 19), luhn(d)).otherwise(F.lit(False))
    marks = F.length(F.regexp_replace(m, r"[A-Za-z0-9 ]", ""))
    capitals, letters = (F.length(F.regexp_replace(m, f"[^{c}]", "")) for c in ("A-Z", "A-Za-z"))
    values = (F.lit(kind), F.least(F.length(d), F.lit(20)), F.least(groups, F.lit(8)), flag(near.rlike(SPEAKS[ALL[kind]])), flag(near.rlike(AGAINST)), flag(check), F.least(marks, F.lit(8)), flag(near.rlike(r"[A-Za-z0-9=_/#]$")), F.least(capitals, F.lit(12)), F.least(letters, F.lit(24)))
    return F.array(*(v.cast("int") for v in values))


def candidates(text: Column) -> Column:
    """What the wide generators propose; proposals of different kinds may overlap."""
    parts = []
    for i, kind in enumerate(ALL):
        made = lambda a, b, m, p, i=i: F.struct(a.alias("start"), b.alias("end"), measured(i, m, p).alias("f"))
        parts.append(F.when(text.rlike(NEEDS[kind]), located(text, WIDE[kind], lambda m: F.lit(True), made, CANDIDATE)).otherwise(none(CANDIDATE)))
    return F.concat(*parts)


# -- boosted trees -----------------------------------------------------------------------------------------------------------

#: Contexts and shapes of written candidates: label, kind, texts before, shapes. In a shape 9 is a digit, ~ a hexadecimal one,
#: ^ a capital or digit; all else stands for itself.
WRITTEN = (
    (1, "phone", ("call ", "Tel. ", "phone: ", "fax ", "tél ", "móvil "), ("999-999-9999", "(999) 999-9999", "0999 9999999", "0999/999999", "999 9999")),
    (0, "phone", ("order ", "pages ", "version ", "from ", "the ", "a "), ("9999-9999", "999 999 999", "999.999.999", "99.9999", "9999-999 9999", "999-999-9999")),
    (1, "card", ("card ", "visa ", "Karte ", "tarjeta: ", "credit card no. "), ("9999 9999 9999 9999", "9999-9999-9999-9999", "9999999999999999")),
    (0, "card", ("order ", "serial ", "id ", "token ", "the ", "a ", "key="), ("9999999999999999", "9999 9999 9999 9", "99999999999999", "9999-9999-9999-9999")),
    (1, "ip", ("host ", "IPv6 ", "address ", "from ", "the "), ("~~~~:~~~~:~~~~:~~~~:~~~~:~~~~:~~~~:~~~~",)),
    (0, "ip", ("hash ", "key ", "token ", "serial "), ("~~~~:~~~~:~~~~:~~~~:~~~~:~~~~:~~~~:~~~~",)),
    (1, "email", ("email ", "contact ", "mailto ", "write to "), ("abc.de (at) mail (dot) org", "ab[at]mail[dot]net", "abc @ mail.org")),
    (0, "email", ("the ", "look ", "version "), ("x @ y. And", "a @ b.9", "9@9.9")),
    (1, "secret", ("export ", "the ", "with ", "", "a "), ("password=~~~~~~~~~~~~", "token = \"~~~~~~~~~~~~~~~~~~~~~~~~\"", "AKIA^^^^^^^^^^^^^^^^", "api_key: ~~~~~~~~~~~~~~~~", "secret=~~~~9~~~^^^^")),
    (0, "secret", ("the ", "a ", "export ", "your "), ("password: required", "token=undefined", "secret: everybody", "api_key=changeme", "password=letters only", "access-key: disabled")),
)
TREES, DEPTH, RATE, WRITTEN_ROWS = 12, 3, 0.5, 4096
PRECISION = 0.97


def written(spark: SparkSession, seed: int, rows: int = WRITTEN_ROWS) -> DataFrame:
    """Labelled candidates: label and features f."""
    flat = [(label, ALL.index(kind), before, shape) for label, kind, contexts, shapes in WRITTEN for before in contexts for shape in shapes]
    table = F.array(*(F.struct(F.lit(a).alias("label"), F.lit(k).alias("kind"), F.lit(b).alias("before"), F.lit(s).alias("shape")) for a, k, b, s in flat))
    out = spark.range(rows).withColumn("w", F.element_at(table, (F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(len(flat))) + 1).cast("int"))).select("id", "w.*")
    drawn = F.pmod(F.xxhash64("id", F.lit(seed + 1)), F.lit(10**17)).cast("string")
    hexed = F.lower(F.hex(F.xxhash64("id", F.lit(seed + 2))))
    base36 = F.concat(F.conv(F.hex(F.xxhash64("id", F.lit(seed + 3))), 16, 36), F.lit("QXK7J2M"))
    at = lambda s, i: F.substring(s, (i % 15) + 1, F.lit(1))
    m = F.array_join(F.transform(F.split("shape", ""), lambda c, i: F.when(c == "9", at(drawn, i)).when(c == "~", at(hexed, i)).when(c == "^", F.upper(at(base36, i))).otherwise(c)), "")
    out = out.withColumn("m", m)
    f = reduce(lambda rest, k: F.when(F.col("kind") == k, measured(k, F.col("m"), F.col("before"))).otherwise(rest), range(len(ALL)), F.lit(None).cast("array<int>"))
    return out.select("label", f.alias("f"))


def grown(rows: list, depth: int):
    """A regression tree by gradient and curvature: a leaf's value, or (feature, threshold, low, high)."""
    g, h = sum(r[1] for r in rows), sum(r[2] for r in rows)
    leaf = -RATE * g / (h + 1.0)
    if not depth:
        return leaf
    best = (1e-6, None)
    for j in range(len(FEATURES)):
        by = {}
        for f, a, b in rows:
            x = by.setdefault(f[j], [0.0, 0.0])
            x[0] += a
            x[1] += b
        gl = hl = 0.0
        for v in sorted(by)[:-1]:
            gl, hl = gl + by[v][0], hl + by[v][1]
            gain = gl * gl / (hl + 1) + (g - gl) ** 2 / (h - hl + 1) - g * g / (h + 1)
            if gain > best[0]:
                best = (gain, (j, v))
    if best[1] is None:
        return leaf
    j, v = best[1]
    return j, v, grown([r for r in rows if r[0][j] <= v], depth - 1), grown([r for r in rows if r[0][j] > v], depth - 1)


def reached(tree, f) -> float:
    while isinstance(tree, tuple):
        tree = tree[2] if f[tree[0]] <= tree[1] else tree[3]
    return tree


_model: list = []


def fitted(spark: SparkSession):
    """(trees, slope and intercept of the calibration, threshold for each kind): the same each time, so fitted once.

    Candidates with equal features are counted before they reach the driver, so it gets at most the written rows.
    """
    if not _model:
        _model.append(_fit(spark))
    return _model[0]


def _fit(spark: SparkSession):

    def tally(seed: int):
        return [(tuple(r.f), r.y, r.n) for r in written(spark, seed).groupBy("f").agg(F.sum("label").alias("y"), F.count("*").alias("n")).orderBy("f").collect()]

    train, held = tally(11), tally(23)
    trees, margin = [], {f: 0.0 for f, _, _ in train}
    for _ in range(TREES):
        rows = []
        for f, y, n in train:
            p = 1 / (1 + math.exp(-margin[f]))
            rows.append((f, n * p - y, n * p * (1 - p)))
        trees.append(grown(rows, DEPTH))
        margin = {f: m + reached(trees[-1], f) for f, m in margin.items()}
    # a logistic fit of the labels of the other draw on the margins
    a, b = 1.0, 0.0
    points = [(sum(reached(t, f) for t in trees), y, n) for f, y, n in held]
    for _ in range(200):
        ga = gb = total = 0.0
        for m, y, n in points:
            e = n / (1 + math.exp(-max(-30, min(30, a * m + b)))) - y
            ga, gb, total = ga + e * m, gb + e, total + n
        a, b = a - 0.5 * ga / total, b - 0.5 * gb / total
    limits = []
    for kind in range(len(ALL)):
        own = sorted(((1 / (1 + math.exp(-(a * sum(reached(t, f) for t in trees) + b))), y, n) for f, y, n in held if f[0] == kind), reverse=True)
        limit, good, seen = 1.1, 0, 0
        for p, y, n in own:
            good, seen = good + y, seen + n
            if good >= PRECISION * seen:
                limit = p
        limits.append(limit)
    return trees, (a, b), limits


def likelihood(model, f: Column) -> Column:
    trees, (a, b), _ = model

    def of(tree) -> Column:
        return F.when(F.get(f, F.lit(tree[0])) <= tree[1], of(tree[2])).otherwise(of(tree[3])) if isinstance(tree, tuple) else F.lit(float(tree))

    return 1 / (1 + F.exp(-(a * reduce(Column.__add__, map(of, trees)) + b)))


def selected(model, found: Column, base: Column) -> Column:
    """Candidates over their kind's threshold that overlap no base span, as spans."""
    limit = F.array(*(F.lit(float(x)) for x in model[2]))
    ok = F.filter(found, lambda c: (likelihood(model, c["f"]) >= F.get(limit, F.get(c["f"], F.lit(0)))) & ~F.exists(base, lambda s: (s["start"] < c["end"]) & (c["start"] < s["end"])))
    return F.transform(ok, lambda c: F.struct(c["start"].alias("start"), F.get(c["f"], F.lit(0)).alias("kind"), c["end"].alias("end")))


# -- the operator ---------------------------------------------------------------------------------------------------------


def with_spans(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs and two last columns: `__base` and `__spans`, arrays of (start, kind, end) in order; offsets in code points.

    Null text counts as empty. Every base match is in both. A span that the trees add overlaps no base span, but may
    overlap another added one; its kind may be `secret`, which has no base pattern. Texts without a digit or an @ are passed over by
    their characters alone.
    """
    model = fitted(docs.sparkSession)
    names = [f"c{i}" for i in range(len(docs.columns))]
    plain = docs.toDF(*names)  # names may clash
    text = F.coalesce(F.col(names[docs.columns.index(text_col)]).cast("string"), F.lit(""))
    some = text.rlike(r"[0-9@]|[\[(]at[\])]|-----BEGIN")
    out = plain.withColumn("__base", F.when(some, base_spans(text)).otherwise(none(SPAN)))
    out = out.withColumn("__wide", F.when(some, candidates(text)).otherwise(none(CANDIDATE)))
    out = out.withColumn("__spans", F.when(F.size("__wide") == 0, F.col("__base")).otherwise(F.array_sort(F.array_distinct(F.concat("__base", selected(model, F.col("__wide"), F.col("__base")))))))
    return out.drop("__wide").toDF(*docs.columns, "__base", "__spans")


def shown(spans: Column) -> Column:
    """kind:start:end by start, then kind, joined by commas."""
    name = F.array(*map(F.lit, ALL))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(name, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_email, n_ip, n_card, n_phone (base matches), base_sha256, spans (all, of every kind), secrets (those of that kind alone) and
    n_found (how many there are) for each row of docs; see with_spans().

    Repeated rows each have a row, null ids stay null, an empty table gives no rows, and other columns are not read.
    """
    out = with_spans(docs.select(F.col(id_col).alias("i"), F.col(text_col).alias("t")), "t")

    def count(i: int) -> Column:
        return F.size(F.filter("__base", lambda s: s["kind"] == i)).cast("long")

    counts = [count(i).alias(f"n_{kind}") for i, kind in enumerate(KINDS)]
    secret = F.filter("__spans", lambda s: s["kind"] == len(KINDS))
    return out.select(F.col("i").alias(id_col), *counts, F.sha2(shown(F.col("__base")), 256).alias("base_sha256"), shown(F.col("__spans")).alias("spans"), shown(secret).alias("secrets"), F.size("__spans").cast("long").alias("n_found"))


def redacted(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with each span replaced by its kind in brackets; overlapping spans are one, of the first one's kind.

    All columns stay, null texts too; a text without spans is unchanged. An empty table gives no rows.
    """
    out = with_spans(docs, text_col)
    names = [f"c{i}" for i in range(len(docs.columns))]
    out = out.toDF(*names, "b", "s")
    key = names[docs.columns.index(text_col)]
    text = F.col(key)
    mark = F.array(*(F.lit(f"[{k.upper()}]") for k in ALL))
    start = F.struct(F.lit(0).alias("at"), F.expr("cast(array() as array<string>)").alias("out"))

    def step(acc: Column, s: Column) -> Column:
        inside = s["start"] < acc["at"]
        piece = F.substring(text, acc["at"] + 1, s["start"] - acc["at"])
        more = F.when(inside, acc["out"]).otherwise(F.concat(acc["out"], F.array(piece, F.get(mark, s["kind"]))))
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), more.alias("out"))

    cut = F.aggregate("s", start, step, lambda acc: F.concat(F.array_join(acc["out"], ""), F.substring(text, acc["at"] + 1, F.length(text))))
    return out.withColumn(key, F.when(F.size("s") > 0, cut).otherwise(text)).drop("b", "s").toDF(*docs.columns)
