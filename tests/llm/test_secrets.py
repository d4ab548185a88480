"""Secret scans."""

import hashlib
import math
import random
import re
import string

from chronaudit.llm import secret_scan as scan

ASSIGN = re.compile(r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")


def plain(text):
    """Known forms as they are specified, without any shortcut."""
    found = [(0, m.start(), m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 12]
    found += [(1, m.start(), m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 18]
    found += [(2, m.start(), m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 16]
    return sorted(found, key=lambda x: (x[1], x[0]))


def test_known_forms():
    draw = random.Random(2)
    parts = [
        "password", "PassWd", "secret", "toKen", "toKen", "ſecret", "api_key", "APIkey", "=", ":", " ", "  ", "'", '"', "AKIA", "AKIAAKIA",
        "ABCDEFGH12", "0123456789abcdef", "deadbeef", "g", "abcdef012345", "x/y+z=-_.", "\n", "é", "token: token: abcdefabcdefabcdef",
    ]
    for _ in range(20_000):
        text = "".join(draw.choice(parts) for _ in range(draw.randint(1, 12)))
        assert scan.known_spans(text) == plain(text), text


def test_battery_tells_random_from_structured():
    draw = random.Random(6)
    alphabet = string.ascii_letters + string.digits
    random_tokens = ["".join(draw.choice(alphabet) for _ in range(48)) for _ in range(300)]
    passed = [scan.battery(t)[3] >= scan.STRUCTURE_LEVEL for t in random_tokens]
    assert sum(passed) >= 290
    for token in ("a" * 40, "ab" * 20, string.ascii_lowercase + "abcdefghij", "0123456789" * 4):
        assert scan.battery(token)[3] < scan.STRUCTURE_LEVEL, token
    assert scan.battery("é" * 30) is None


def test_false_discoveries_are_controlled_by_class_of_length():
    counts = {(0, 0): 990, (0, 200): 10, (1, 0): 10, (1, 200): 10, (2, -1): 5, (2, 400): 1}
    least = scan.controlled(counts, 0.01)
    assert least == {0: 200, 1: 200, 2: 400}
    assert scan.controlled({(0, 0): 1000, (0, 100): 1}, 0.01) == {}  # one of a thousand at 0.01 is chance


def wanted_rows(rows, spans_of):
    out = []
    for i, text in rows:
        text = text or ""
        base = plain(text)
        named = ",".join(f"{scan.KINDS[k]}:{s}:{e}" for k, s, e in base)
        kinds = [k for k, _, _ in base]
        out.append((i, kinds.count(0), kinds.count(1), kinds.count(2), hashlib.sha256(named.encode()).hexdigest(), spans_of(text)))
    return sorted(out, key=str)


def test_find_secrets(odd_docs, sample, no_docs):
    for docs in (odd_docs, sample):
        rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
        model = scan.fit(scan.evidence(docs))
        wanted = wanted_rows(rows, lambda t, m=model: scan._named(m.spans(t)))
        assert sorted(map(tuple, scan.find_secrets(docs).collect()), key=str) == wanted
    assert scan.find_secrets(no_docs).collect() == []
    assert scan.mask_secrets(no_docs).collect() == []


def test_random_tokens_are_added_and_words_are_not(spark, sample):
    draw = random.Random(8)
    alphabet = string.ascii_letters + string.digits
    keys = ["".join(draw.choice(alphabet) for _ in range(64)) for _ in range(40)]
    extra = [(10_000 + i, f"see {k} there, and thisisaverylongwordofnaturaltext too") for i, k in enumerate(keys)]
    docs = sample.select("doc_id", "text").unionByName(spark.createDataFrame(extra, "doc_id bigint, text string"))
    rows = scan.find_secrets(docs).filter("doc_id >= 10000").collect()
    found = [r for r in rows if re.fullmatch("random:4:68", r["spans"])]
    assert len(found) >= 36
    assert all(r["spans"] in ("", "random:4:68") for r in rows)


def test_masks(odd_docs):
    assert scan.masked("ab12cd", [(0, 2, 4)]) == "ab[secret]cd"
    assert scan.masked("abcdef", [(0, 1, 4), (2, 3, 5), (1, 5, 6)]) == "a[secret][secret]"
    masked = scan.mask_secrets(odd_docs)
    assert masked.columns == odd_docs.columns and masked.count() == odd_docs.count()
    row = masked.filter("doc_id = 9").first()
    assert "hunter2" not in row["text"] and "AKIA" not in row["text"] and row["text"].count(scan.MASK) == 2
    assert masked.filter("text is null").count() == odd_docs.filter("text is null").count()


def test_natural_moments():
    """Mean and variance of chi-squared for drawn text are near those computed."""
    draw = random.Random(1)
    histogram = __import__("numpy").zeros(256, dtype="int64")
    weights = [1 / (i + 1) for i in range(26)]
    for c, w in zip(string.ascii_lowercase, weights, strict=True):
        histogram[ord(c)] = int(1e6 * w)
    natural = scan.Natural.of(histogram)
    values = [scan.battery("".join(draw.choices(string.ascii_lowercase[:26], weights, k=60))) for _ in range(400)]
    lower = scan.NAMES.index("lower")
    base, slope, noise, growth = natural.moments[lower]
    own = [v[2] for v in values if v and v[0] == lower]
    assert abs(sum(own) / len(own) - (base + 60 * slope)) < 4 * math.sqrt((noise + 60 * growth) / len(own)) + 2
