import hashlib
import random
import re

from tallyline.llm import pii

# the patterns of the contract
PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(d):
    total = 0
    for i, c in enumerate(reversed(d)):
        v = int(c) * (1 + i % 2)
        total += v - 9 * (v > 9)
    return total % 10 == 0


def base_of(text):
    out = []
    for rank, (kind, pattern) in enumerate(PLAIN.items()):
        for m in re.finditer(pattern, text or ""):
            d = re.sub("[^0-9]", "", m[0])
            ok = {"email": True, "ip": kind == "ip" and all(int(p) <= 255 for p in m[0].split(".")),
                  "card": 12 <= len(d) <= 19 and luhn(d), "phone": 9 <= len(d) <= 15}[kind]
            if ok:
                out.append((m.start(), rank, m.end()))
    return sorted(out)


def texts():
    rng = random.Random(4)
    alphabet = "ab.@+-0123456789 ()é\n_%4😀"
    out = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 120))) for _ in range(150)]
    out += [rng.choice(["x ", "é", ""]) + rng.choice(["4111 1111 1111 1111", "4111-1111-1111-1112", "a@b.c_d@e.f", "x.y@z.w@v.u", "1.2.3.4.5.6.7.8", "300.1.1.1",
            "0001.2.3.4", "+1 (555) 123-4567", "+1-2", "+49 30 1234 5678 9012 3456", "call 0049 30 1234567", "😀 me@x.org", "a@b", "@a.b", "7.7.7.7.", "12345678901234567890123"])
            + rng.choice([".", " end", "\n"]) for _ in range(150)]
    return out + ["", None, "1" * 30_000, "1 " * 9_000, "a" * 60_000, "a.a@" * 2_000, "a@b.c " * 400, "1." * 9_000, "a" * 20_000 + "@b" + ".c" * 9_000, "\x00 a@b.c"]


def test_base_against_brute_force(spark):
    all_texts = texts()
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(all_texts)], "doc_id long, text string, spans string")
    rows = pii.digest(docs).orderBy("doc_id").collect()
    assert len(rows) == len(all_texts)
    for row, text in zip(rows, all_texts):
        base = base_of(text)
        listed = [f"{pii.KINDS[k]}:{s}:{e}" for s, k, e in base]
        assert row.base_sha256 == hashlib.sha256(",".join(listed).encode()).hexdigest(), (text or "")[:200]
        assert [row.n_email, row.n_ip, row.n_card, row.n_phone] == [sum(k == n for _, k, _ in base) for n in range(4)]
        spans = [x for x in row.spans.split(",") if x]
        assert set(listed) <= set(spans)
        keys = [(int(s), pii.KINDS.index(k), int(e)) for k, s, e in (x.split(":") for x in spans)]
        assert keys == sorted(keys)


def test_redaction(spark):
    docs = spark.createDataFrame([(1, "mail a@b.com or +1 (555) 123-4567.", 9), (2, "clean", 5), (3, None, 0), (4, "", 0)], "doc_id long, text string, n_chars int")
    rows = pii.redacted(docs).orderBy("doc_id").collect()
    assert [r.text for r in rows] == ["mail <email> or <phone>.", "clean", None, ""] and rows[0].n_chars == 9


def test_copies_do_not_fill_the_sample(spark):
    texts = [f"mail u{i}@host{i}.org" if i % 2 else f"mail u{i}(at)host{i}" for i in range(80)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    hashed = pii.with_spans(docs, "doc_id", "text").selectExpr("t", "explode(cand) AS c").selectExpr("t", "xxhash64(c.m, c.before, c.after) AS h")
    lowest = hashed.orderBy("h").first().t
    many = docs.union(spark.createDataFrame([(1000 + i, lowest) for i in range(300)], docs.schema))
    assert pii.fit_candidates(pii.with_spans(many, "doc_id", "text"), fit_rows=100) is not None


def test_empty(spark):
    assert pii.digest(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_trees_add_what_the_base_misses(spark):
    """On labelled texts of another seed: precision and recall of the added spans, and none inside tokens."""
    other = pii.labelled_texts(15, seed=123)
    docs = spark.createDataFrame([(i, t) for i, t, _ in other], "doc_id long, text string")
    found = {r["__key"]: r for r in pii.find_pii(docs).collect()}
    right = wrong = missed = 0
    for i, text, spans in other:
        base = {(x.kind, x.s, x.e) for x in found[i].base}
        added = {(x.kind, x.s, x.e) for x in found[i].spans} - base
        right, wrong, missed = right + len(added & set(spans)), wrong + len(added - set(spans)), missed + len(set(spans) - added - base)
        assert not (added and any(w in text for w in ("token", "password", "secret", "key ")))
    assert right >= 150 and right / (right + wrong) >= 0.95 and right / (right + missed) >= 0.8


def test_spans_a_base_pattern_swallowed(spark):
    text = "hello. +1 (605) 555-9305 4078918989542222 bye"
    row = pii.digest(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert row.n_phone == row.n_card == 0 and row.spans == "phone:7:24,card:25:41"
    clean = pii.redacted(spark.createDataFrame([(1, text, "x")], "doc_id long, text string, source string")).first()
    assert clean.text == "hello. <phone> <card> bye"


def test_own_labels(spark):
    """Another labelled table decides otherwise; one class alone adds nothing."""
    docs = spark.createDataFrame([(1, "code 00316 858 5243 here"), (2, "a(at)b.org")], "doc_id long, text string")
    one = spark.createDataFrame([("see a(at)b.org", [])], "text string, truth array<struct<kind: int, s: int, e: int>>")
    assert [r.spans for r in pii.find_pii(docs, labelled=one).collect()] == [[], []]
