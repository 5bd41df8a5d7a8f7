"""Personal data: high-recall generators, boosted trees over format and context, calibrated threshold, redaction.

Base spans are patterns with a validity check, leftmost and non-overlapping per kind. Generators propose further, possibly
overlapping spans: mail addresses in disguise, numbers with unusual separators, and those that a base pattern swallowed together
with their neighbours. A boosted tree model scores them by format and context, and those above a threshold join the base spans
unless they overlap one. The model is fitted on a table of labelled texts, by default the one of ``labelled_texts`` (made from
templates: true spans of many forms, and look-alikes such as hexadecimal tokens, order numbers, dates and versions); the
threshold is the lowest at which a held-out part of it reaches the wanted precision. Its candidates are reduced to distinct
ones, their counts being weights, at most ``fit_rows``. The trees become one SQL expression, so scoring stays inside the row:
nothing is exploded or shuffled.

Positions are code points, ends are exclusive. Defined results: null text is empty; empty texts and tables have no spans.
Repeated rows are scanned alike. Very long texts are searched whole, in linear time. Without labelled candidates of both classes
nothing is added. Only the named columns are read.
"""

from __future__ import annotations

import random
import re

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, functions as F

# The base patterns. A look-behind (or the end of the last match) keeps the search linear in long runs of
# one class, possessive quantifiers keep the matcher's stack flat; neither changes what is found.
KINDS = ("email", "ip", "card", "phone")
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++(?:\.[0-9]++)(?:\.[0-9]++)(?:\.[0-9]++)",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
# cheap necessary conditions; only texts that meet them are searched
GATES = {
    "email": "contains(t, '@')",
    "ip": r"t rlike r'[0-9]\.[0-9]'",
    "card": r"t rlike r'[0-9](?:[\x20-]?[0-9]){11}'",
    "phone": "contains(t, '+')",
}
# generators of further candidates, by kind
GENERATORS = {
    "email": (r"(?<![^\s])[^\s@]{1,64}(?:@|\(at\)|\[at\])[^\s@]{1,64}(?=\s|$)", r"t rlike r'@|\(at\)|\[at\]'"),
    "ip": (r"(?<![0-9.])[0-9]{1,4}(?:\.[0-9]{1,4}){3,5}+(?![0-9])", r"t rlike r'[0-9]\.[0-9]+\.[0-9]'"),
    "card": (r"(?<![0-9])[0-9](?:[\x20.-]?[0-9]){11,18}+(?![0-9])", r"t rlike r'[0-9](?:[\x20.-]?[0-9]){11}'"),
    "phone": (r"(?<![0-9A-Za-z])(?:\+|00)?\(?[0-9](?:[\x20().-]{0,2}[0-9]){6,14}+(?![0-9])", r"t rlike r'[0-9](?:[\x20().-]{0,2}[0-9]){6}'"),
}
# a number in groups that ends where its last group does, whatever digits follow after a space
GROUPED = (r"(?<![0-9A-Za-z])\+[0-9]{1,3}[\x20.-]?\(?[0-9]{2,4}\)?[\x20.-]?[0-9]{3,4}[\x20.-]?[0-9]{3,4}(?![0-9])", "contains(t, '+')")
PROPOSED = [(k, *GENERATORS[kind]) for k, kind in enumerate(KINDS)] + [(KINDS.index("phone"), *GROUPED)]
CONTEXT = 24
FIT_ROWS = 20_000
TREES, DEPTH = 12, 4
PRECISION = 0.95
FEATURES = (
    "double(c.kind)", "double(length(c.m))", "double(length(regexp_replace(c.m, '[^0-9]', '')))", "double(length(regexp_replace(c.m, '[^A-Za-z]', '')))",
    "double(size(split(c.m, '[.]')))", "double(size(split(c.m, '[ ()-]')))", "double(startswith(c.m, '+'))", "double(contains(c.m, '@'))",
    "double(c.m rlike '@[A-Za-z0-9-]+[.]')", "double(c.m rlike '[^\\\\x00-\\\\x7F]')",
    "coalesce(array_max(transform(split(c.m, '[^0-9]+'), p -> try_cast(p AS double))), -1D)",
    "double(c.before rlike '(?i)(mail|contact|write)')", "double(c.before rlike '(?i)(tel|phone|call|fax)')", "double(c.before rlike '(?i)(card|visa|pay)')",
    "double(c.before rlike '(?i)(token|key|secret|id)[^a-z]*$')", "double(c.before rlike '[0-9][^A-Za-z]{0,3}$')", "double(c.after rlike '^[^A-Za-z]{0,3}[0-9]')",
    "double(c.before rlike '[A-Za-z]$')", "double(c.after rlike '^[A-Za-z]')", "double(c.m rlike '[(\\\\[]at[)\\\\]]')", "double(c.m rlike '[.][A-Za-z]{2,6}$')",
    "double(startswith(c.m, '00'))", "double(c.before rlike '(?i)(order|invoice|isbn|version|serial|no)[^a-z]*$')", "double(c.m rlike '(19|20)[0-9][0-9]-[01][0-9]-[0-3][0-9]')",
    "{luhn}",
)
DRAWS = 40  # texts made from every template


def _luhn_digits(rng: random.Random, n: int) -> str:
    body = "".join(rng.choice("0123456789") for _ in range(n - 1))
    body = rng.choice("3456") + body[1:]
    total = 0
    for i, c in enumerate(reversed(body)):
        v = int(c) * (2 - i % 2)
        total += v - 9 * (v > 9)
    return body + str(-total % 10)


# Templates of labelled texts: [kind:span] marks a true span, everything else is a look-alike.
# {w} word, {host} domain, {d3} {d4} digits, {card} {nocard} 16 digits that pass or fail Luhn, {hex} token
TEMPLATES = (
    "{w} {w} [email:{w}(at){host}] {w}", "write to [email:{w}.{w}[at]{host}] {w} {w}", "mail [email:{w}@{host}], {w}", "contact [email:{w}{d3}(at){host}]",
    "{w} meet(at)noon {w}", "{w} [at]least {w} x(at)y {w}", "price(at){d3} {w}", "{w}@{w} said {w}", "see @{w} and {w}@ {w}", "{w}[at]{w} {w}",
    "call [phone:00{d3} {d3} {d4}] {w}", "tel. [phone:(0{d3}) {d3}-{d4}] {w}", "phone: [phone:{d3}-{d3}-{d4}]", "fax [phone:{d3}.{d3}.{d4}] {w}", "{w} [phone:+1 ({d3}) {d3}-{d4}] {w}",
    "{w}. [phone:+1 ({d3}) {d3}-{d4}] [card:{card}] {w}", "{w} [phone:+1 ({d3}) {d3}-{d4}] {nocard} {w}", "{w} [phone:+44 {d4} {d3} {d3}] [card:{card}]. {w}",
    "order {d4}{d4} {w}", "invoice no {d3}-{d4}-{d3} {w}", "isbn 978-{d3}-{d4}-{d3} {w}", "on 2024-01-{d2} 10:{d2}:{d2} {w}", "serial {d4}-{d4}-{d4}", "{w} {d4}{d3} {w} {w}",
    "pay with [card:{cdot}] {w}", "card [card:{card}] {w}", "visa [card:{cdash}] {w}", "{w} [card:{card}] {w} {w}", "{w} {nocard} {w}", "number {ndot} {w}", "{w} {nocard}, {w}",
    "token = \"{hex}{d4}{d4}{d4}{hex}\" {w}", "password={hex}{d4}{d3}{hex} {w}", "key \"{hex}{card}{hex}\" {w}", "id {hex}{card}{hex}", "secret={hex}{d4}{d4}{d2}{hex} {w}",
    "version {d1}.{d1}.{d1}.{d1}.{d1} {w}", "{w} {d4}.{d4}.{d3}.{d4} {w}", "[ip:10.{d2}.1.{d2}] {w} {w}", "section {d1}.{d1}.{d1}.{d1}.{d2}", "{w} 9{d3}.1.2.3 {w}",
)


def labelled_texts(draws: int = DRAWS, seed: int = 9) -> list[tuple[int, str, list[tuple[int, int, int]]]]:
    """(number, text, [(kind, start, end)]): ``draws`` texts of every template, the same for the same seed."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice(["an", "er", "to", "mi", "so", "el", "qu", "ba"]) for _ in range(rng.randint(1, 4)))
    digits = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
    grouped = lambda x, by: by.join(x[i: i + 4] for i in range(0, 16, 4))

    def failing() -> str:
        x = _luhn_digits(rng, 16)
        return x[:-1] + str((int(x[-1]) + rng.randint(1, 9)) % 10)

    parts = {
        "w": word, "host": lambda: f"{word()}.{rng.choice(['com', 'org', 'net', 'example.com', 'de'])}", "card": lambda: _luhn_digits(rng, 16), "nocard": failing,
        "cdot": lambda: grouped(_luhn_digits(rng, 16), "."), "cdash": lambda: grouped(_luhn_digits(rng, 16), "-"), "ndot": lambda: grouped(failing(), "."),
        "hex": lambda: "".join(rng.choice("0123456789abcdef") for _ in range(rng.randint(4, 20))) + rng.choice("abcdef"),
    } | {f"d{n}": (lambda n=n: digits(n)) for n in (1, 2, 3, 4)}
    out = []
    for template in TEMPLATES:
        for _ in range(draws):
            made = re.sub(r"{(\w+)}", lambda m: parts[m[1]](), template)
            text, spans, at = "", [], 0
            for m in re.finditer(r"\[(" + "|".join(KINDS) + r"):((?:[^\[\]]|\[at\])*)\]", made):
                text += made[at: m.start()]
                spans.append((KINDS.index(m[1]), len(text), len(text) + len(m[2])))
                text, at = text + m[2], m.end()
            out.append((len(out), text + made[at:], spans))
    return out


def labelled_table(spark, draws: int = DRAWS, seed: int = 9) -> DataFrame:
    return spark.createDataFrame(labelled_texts(draws, seed), "number int, text string, truth array<struct<kind: int, s: int, e: int>>")


def find_sql(pattern: str, gate: str) -> str:
    """array<struct<s, m>>: start in code points and text of the matches of ``pattern`` in ``t``."""
    text, pieces = f"regexp_extract_all(t, r'{pattern}', 0)", f"split(t, r'{pattern}', -1)"
    walk = (
        "aggregate(sequence(0, size(ms) - 1), struct(0 AS at, cast(array() AS array<struct<s: int, m: string>>) AS found), (a, i) -> "
        "struct(a.at + length(ps[i]) + length(ms[i]) AS at, array_append(a.found, struct(a.at + length(ps[i]) AS s, ms[i] AS m)) AS found), a -> a.found)"
    )
    bound = f"element_at(transform(array(struct({text} AS ms, {pieces} AS ps)), x -> {re.sub(r'(ms|ps)([\\[)])', r'x.\1\2', walk)}), 1)"
    return f"if({gate} AND t rlike r'{pattern}', {bound}, cast(array() AS array<struct<s: int, m: string>>))"


def luhn_sql(digits: str) -> str:
    """Luhn check of a string of digits."""
    doubled = "if(i % 2 = 0, int(substring(r, i + 1, 1)), int(substring('0246813579', int(substring(r, i + 1, 1)) + 1, 1)))"
    return f"element_at(transform(array(reverse({digits})), r -> aggregate(sequence(0, length(r) - 1), 0, (a, i) -> a + {doubled}) % 10 = 0), 1)"


DIGITS = "regexp_replace(x.m, '[^0-9]', '')"
VALID = {
    "email": "true",
    "ip": "forall(split(x.m, '[.]'), p -> double(p) <= 255)",
    "card": f"length({DIGITS}) BETWEEN 12 AND 19 AND if(length({DIGITS}) BETWEEN 12 AND 19, {luhn_sql(DIGITS)}, false)",
    "phone": f"length({DIGITS}) BETWEEN 9 AND 15",
}


def with_spans(docs: DataFrame, key: str, text: str, carry: tuple[str, ...] = ()) -> DataFrame:
    """(key, t, email, ip, card, phone, base, cand): base spans by kind and the generators' candidates with their context."""
    rows = docs.select(F.col(key).alias("__key"), F.coalesce(F.col(text), F.lit("")).alias("t"), *carry)
    base = [f"filter({find_sql(PATTERNS[k], GATES[k])}, x -> {VALID[k]}) AS {k}" for k in KINDS]
    raw = [
        f"transform({find_sql(pattern, gate)}, c -> struct({kind} AS kind, c.s AS s, c.s + length(c.m) AS e, c.m AS m, "
        f"substring(t, greatest(1, c.s + 1 - {CONTEXT}), least(c.s, {CONTEXT})) AS before, substring(t, c.s + length(c.m) + 1, 8) AS after)) AS g{n}"
        for n, (kind, pattern, gate) in enumerate(PROPOSED)
    ]
    spans = ", ".join(f"transform({k}, x -> struct({n} AS kind, x.s AS s, x.s + length(x.m) AS e))" for n, k in enumerate(KINDS))
    every = ", ".join(f"g{n}" for n in range(len(PROPOSED)))
    return rows.selectExpr("__key", "t", *carry, *base, *raw).selectExpr(
        "__key", "t", *carry, *KINDS, f"concat({spans}) AS base", f"array_distinct(concat({every})) AS cand")


def feature_sql() -> str:
    digits = "regexp_replace(c.m, '[^0-9]', '')"
    checked = f"if(length({digits}) BETWEEN 12 AND 19, double({luhn_sql(digits)}), -1D)"
    return "array(" + ", ".join(f.replace("{luhn}", checked) for f in FEATURES) + ")"


def tree_sql(tree) -> str:
    """A regression tree as nested CASE over the feature array ``f``."""
    lines = [line.strip() for line in tree.toDebugString.splitlines()[1:] if line.strip()]

    def read(at: int) -> tuple[str, int]:
        if leaf := re.fullmatch(r"Predict: (\S+)", lines[at]):
            return f"{float(leaf[1])!r}D", at + 1
        feature, bound = re.match(r"If \(feature (\d+) <= (\S+)\)", lines[at]).groups()
        yes, at = read(at + 1)
        no, at = read(at + 1)  # skips the Else line
        return f"if(f[{feature}] <= {float(bound)!r}D, {yes}, {no})", at

    return read(0)[0]


def fit_candidates(rows: DataFrame, fit_rows: int = FIT_ROWS, precision: float = PRECISION) -> tuple[str, float] | None:
    """(SQL of the probability over ``f``, threshold) from at most ``fit_rows`` distinct candidates weighted by count, or None.

    A candidate is right if it is one of the spans in ``truth``, or in ``base`` where there is no such column.
    """
    truth = "truth" if "truth" in rows.columns else "base"
    label = f"double(exists({truth}, b -> b.kind = c.kind AND b.s = c.s AND b.e = c.e))"
    cases = rows.where("size(cand) > 0").selectExpr(truth, "explode(cand) AS c").selectExpr(
        "c.kind", "c.m", "c.before", "c.after", f"{label} AS label")
    # copies are counted first: side by side by hash, those of one candidate could fill the sample
    cases = cases.groupBy("kind", "m", "before", "after", "label").agg(F.count("*").cast("double").alias("n"))
    cases = cases.withColumn("h", F.xxhash64("m", "before", "after")).orderBy("h", "label", "kind", "m", "before", "after").limit(fit_rows)
    sample = cases.selectExpr("struct(kind, m, before, after) AS c", "label", "n", "h").selectExpr(f"{feature_sql()} AS f", "label", "n", "h").cache()
    try:
        train = sample.where("pmod(h, 5) <> 0").select(array_to_vector("f").alias("features"), "label", "n")
        low, high = train.agg(F.min("label"), F.max("label")).first()
        if low is None or low == high:
            return None
        model = GBTClassifier(maxIter=TREES, maxDepth=DEPTH, seed=7, maxBins=64, weightCol="n").fit(train)
        margin = " + ".join(f"{w!r}D * {tree_sql(t)}" for t, w in zip(model.trees, model.treeWeights))
        chance = f"1D / (1D + exp(-2D * ({margin})))"
        steps = [k / 20 for k in range(10, 20)]
        held = sample.where("pmod(h, 5) = 0").selectExpr(f"{chance} AS p", "label", "n")
        right = held.agg(*[F.expr(f"sum(label * n) FILTER (WHERE p >= {s}) / sum(n) FILTER (WHERE p >= {s})").alias(f"s{k}") for k, s in enumerate(steps)]).first()
        return chance, next((s for k, s in enumerate(steps) if right[k] is not None and right[k] >= precision), steps[-1])
    finally:
        sample.unpersist()


def find_pii(docs: DataFrame, key: str = "doc_id", text: str = "text", labelled: DataFrame | None = None, fit_rows: int = FIT_ROWS, precision: float = PRECISION) -> DataFrame:
    """(__key, t, base, spans): arrays of struct(s, kind, e), base ones and all, sorted.

    ``labelled`` has (text, truth), ``truth`` being the array of struct(kind, s, e) of its true spans.
    """
    rows = with_spans(docs, key, text)
    labelled = labelled_table(docs.sparkSession) if labelled is None else labelled.withColumn("number", F.lit(0))
    fitted = fit_candidates(with_spans(labelled, "number", "text", ("truth",)), fit_rows, precision)
    extra = "cast(array() AS array<struct<kind: int, s: int, e: int>>)"
    if fitted is not None:
        chance, threshold = fitted
        kept = f"NOT exists(base, b -> b.s < c.e AND c.s < b.e) AND element_at(transform(array({feature_sql()}), f -> {chance}), 1) >= {threshold}D"
        extra = f"transform(filter(cand, c -> {kept}), c -> struct(c.kind AS kind, c.s AS s, c.e AS e))"
    order = "array_sort(array_distinct(transform({}, x -> struct(x.s AS s, x.kind AS kind, x.e AS e))))"
    return rows.selectExpr("__key", "t", *KINDS, f"{order.format('base')} AS base", f"{order.format(f'concat(base, {extra})')} AS spans")


def listed_sql(spans: str) -> str:
    names = "array(" + ", ".join(f"'{k}'" for k in KINDS) + ")"
    return f"array_join(transform({spans}, x -> concat({names}[x.kind], ':', x.s, ':', x.e)), ',')"


def digest(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Counts per kind, hash of the base spans and all spans as text, per row."""
    return find_pii(docs, key, text).selectExpr(
        f"__key AS `{key}`", *[f"bigint(size({k})) AS n_{k}" for k in KINDS], f"sha2({listed_sql('base')}, 256) AS base_sha256", f"{listed_sql('spans')} AS spans")


def redacted(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with every span replaced by its kind in angle brackets (overlapping spans by that of the first)."""
    names = "array(" + ", ".join(f"'<{k}>'" for k in KINDS) + ")"
    kept = docs.withColumn("__row", F.struct(*docs.columns))
    found = find_pii(kept, "__row", text)
    # a span that begins inside the text already replaced is swallowed by it
    rebuilt = (
        f"aggregate(spans, struct(0 AS at, '' AS done), (a, x) -> if(x.s >= a.at, struct(x.e AS at, concat(a.done, substring(t, a.at + 1, x.s - a.at), {names}[x.kind]) AS done), "
        "struct(greatest(a.at, x.e) AS at, a.done AS done)), a -> concat(a.done, substring(t, a.at + 1)))"
    )
    clean = found.selectExpr("__key", f"if(__key.`{text}` IS NULL, NULL, if(size(spans) = 0, t, {rebuilt})) AS clean")
    return clean.select(*[F.col("clean").alias(c) if c == text else F.col("__key").getField(c).alias(c) for c in docs.columns])
