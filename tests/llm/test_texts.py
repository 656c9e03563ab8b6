"""Duplicates, joins, secrets, quality, media and scores against brute force."""

import collections
import hashlib
import random
import re
import struct
import zlib

import numpy as np
import pyarrow as pa
import pytest

from quantwell.llm import jaccard, media, pseudolm, quality, secrets, suffixes
from quantwell.llm.common import Scratch, as_bytes
from quantwell.llm.graph import components

WORDS = r"[^\x20\x09-\x0D]+"


def keyed(row):
    return tuple((v is not None, v) if v is not None else (False, 0) for v in row)


# suffix-array dedup


def removed_by_force(rows, length):
    first: dict = {}
    for k, t in sorted((k, (t or "").encode()) for k, t in rows if k is not None):
        for i in range(len(t) - length + 1):
            first.setdefault(t[i : i + length], k)
    out = []
    for k, text in rows:
        t = (text or "").encode()
        gone = bytearray(len(t))
        for i in range(len(t) - length + 1 if k is not None else 0):
            if first[t[i : i + length]] < k:
                gone[i : i + length] = b"\1" * length
        runs = len(re.findall(b"\1+", bytes(gone)))
        out.append((k, len(t), sum(gone), runs, hashlib.sha256(bytes(b for b, g in zip(t, gone) if not g)).hexdigest()))
    return sorted(out, key=keyed)


def test_duplicates_of_odd_documents(odd, none):
    rows, docs = odd
    assert sorted(map(tuple, suffixes.duplicate_report(docs).collect()), key=keyed) == removed_by_force(rows, 50)
    assert suffixes.duplicate_report(none).count() == 0
    left = {r.doc_id: r for r in suffixes.remove_duplicates(docs).collect()}
    assert left[8].text == "" and left[8].n_chars == 0 and left[7].text == "One two three. " * 40 and left[1].text is None


@pytest.mark.parametrize("length", [16, 20, 50, 300])
def test_duplicates_of_random_documents(spark, length, monkeypatch):
    random.seed(length)
    pool = ["".join(random.choice("abéz ") for _ in range(random.randint(10, 120))) for _ in range(25)]
    rows = [(random.randint(0, 60), "".join(random.choice(pool) for _ in range(random.randint(0, 6)))) for _ in range(80)]
    for name in ("_BLOCK", "_HASH_BUCKET", "_WINDOW_BUCKET"):
        monkeypatch.setattr(suffixes, name, 4000)
    if length == 300:
        rows += [(k % 70, "".join(pool) * 2) for k in range(61, 69)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert sorted(map(tuple, suffixes.duplicate_report(docs, length=length).collect()), key=keyed) == removed_by_force(rows, length)


def test_earlier_in_suffix_order():
    text = np.frombuffer(b"abcabcabd", np.uint8)
    starts, owner = np.arange(7), np.array([3, 1, 2, 2, 1, 2, 0])
    want = [any(text[j : j + 3].tobytes() == text[i : i + 3].tobytes() and owner[j] < owner[i] for j in range(7)) for i in range(7)]
    assert suffixes.earlier_in_suffix_order(text, starts, owner, 3).tolist() == want


@pytest.mark.parametrize("length", [3, 8, 21, 24])
def test_longest_previous_factors(length):
    random.seed(length)
    text = np.frombuffer("".join(random.choice("ab" if k % 3 else "abc") for k in range(400)).encode(), np.uint8)
    starts = np.array(random.sample(range(len(text) - length + 1), 250))
    owner = np.array([random.randint(0, 40) for _ in starts])

    def common(i, j):
        a, b = text[i : i + length], text[j : j + length]
        return length if (a == b).all() else int(np.argmax(a != b))

    want = [max((common(i, j) for j, q in zip(starts, owner) if q < p), default=0) for i, p in zip(starts, owner)]
    assert suffixes.longest_previous_factors(text, starts, owner, length).tolist() == want


# n-gram Jaccard join


def components_by_force(rows, width, p, q):
    sets, root = collections.defaultdict(list), {}
    for k, t in rows:
        words = re.findall(WORDS, re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        own = {tuple(words[i : i + width]) for i in range(len(words) - width + 1)} if len(words) >= width else ({tuple(words)} if words else set())
        sets[k].append(own)
        root[k] = k
    keys = [k for k in root if k is not None]

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    def alike(x, y):
        return bool(x and y) and q * len(x & y) >= p * len(x | y)

    for a in keys:
        for b in keys:
            if a < b and any(alike(x, y) for x in sets[a] for y in sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    every = [s for k in keys for s in sets[k]]
    n_links = lambda k, s: max(0, sum(alike(s, x) for x in every) - 1) if k is not None else 0
    return sorted(((k, len(s), find(k) if k is not None else None, n_links(k, s)) for k in root for s in sets[k]), key=keyed)


def test_join_of_odd_documents(spark, odd, none):
    rows, docs = odd
    assert sorted(map(tuple, jaccard.jaccard_components(docs, Scratch(spark), width=3, p=90).collect()), key=keyed) == components_by_force(rows, 3, 90, 100)
    assert jaccard.jaccard_components(none, Scratch(spark)).count() == 0


@pytest.mark.parametrize("width,p,broadcast,shingles", [(3, 90, 1 << 18, 4_000_000), (5, 80, 0, 60), (1, 60, 1 << 18, 100)])
def test_join_of_random_documents(spark, monkeypatch, width, p, broadcast, shingles):
    random.seed(p)
    monkeypatch.setattr(jaccard, "BROADCAST_ROWS", broadcast)
    monkeypatch.setattr(jaccard, "BUCKET_SHINGLES", 300)
    monkeypatch.setattr(jaccard, "_BLOCK", 3000)
    bases = [[random.choice("ABCDEFGHIJKLMNOP") + random.choice("xyz") for _ in range(random.choice([4, 12, 40, 90]))] for _ in range(12)]
    rows = []
    for k in range(120):
        own = list(random.choice(bases))
        for _ in range(random.choice([0, 0, 1, 2, 5])):
            own[random.randrange(len(own))] = random.choice("QRST")
        rows.append((k * 7 % 120, " ".join([*["hot", "line", "of", "many", "texts", "here"] * (k % 2), *own])))
    rows += [(k, text + " and more words of its own") for k, text in rows[:9]]  # of one doc_id
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = jaccard.jaccard_components(docs, Scratch(spark), width=width, p=p, search_shingles=shingles)
    assert sorted(map(tuple, got.collect()), key=keyed) == components_by_force(rows, width, p, 100)


def test_first_of_each_component(spark, odd, none, monkeypatch):
    rows, docs = odd
    small = {k for k, _, c, _ in components_by_force(rows, 5, 80, 100) if k == c}
    for most in (1 << 18, 0):
        monkeypatch.setattr(jaccard, "BROADCAST_ROWS", most)
        got = jaccard.first_of_each(docs, Scratch(spark))
        assert got.columns == docs.columns and sorted((r.doc_id or 0) for r in got.collect()) == sorted(k or 0 for k, _ in rows if k is None or k in small)
    assert jaccard.first_of_each(none, Scratch(spark)).count() == 0


def test_searches_find_every_link():
    random.seed(2)
    for p in (50, 80, 90):
        sets, seen = [], set()
        for _ in range(60):
            own = np.unique(np.array(random.choice(sets) if sets and random.random() < 0.6 else [random.randint(0, 99) for _ in range(30)], np.uint64))
            own = np.unique(np.append(own[: random.randint(len(own) - 2, len(own))], np.uint64(random.randint(0, 99))))
            if own.tobytes() not in seen:
                seen.add(own.tobytes())
                sets.append(own)
        own = [set(s.tolist()) for s in sets]
        copies = [random.randint(1, 3) for _ in sets]
        want = [sum(c for y, c in zip(own, copies, strict=True) if y is not x and 100 * len(x & y) >= p * len(x | y)) for x in own]
        assert jaccard.search(list(range(len(sets))), sets, copies, None, p, 100)[1] == want


def test_components(spark):
    random.seed(9)
    edges = [(random.randint(0, 300), random.randint(0, 300)) for _ in range(220)] + [(k, k + 1) for k in range(1000, 1060)]
    root = {x: x for e in edges for x in e}
    for _ in range(100):
        for a, b in edges:
            root[a] = root[b] = min(root[a], root[b])
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "u long, v long"), Scratch(spark)).collect()}
    alone = {a for a, b in edges if a == b} - {x for e in edges if e[0] != e[1] for x in e}
    assert got == {k: v for k, v in root.items() if k not in alone}


# secrets

BASE = {
    "assign": (re.compile(r"""((?:p|P)(?:a|A)(?:s|S)(?:s|S)(?:w|W)(?:o|O)(?:r|R)(?:d|D)|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']? *[:=] *["']?([A-Za-z0-9+/_.=-]+)"""), lambda m: len(m[2]) >= 8),
    "access": (re.compile("AKIA[A-Z0-9]+"), lambda m: len(m[0]) >= 16),
    "hex": (re.compile("[0-9a-f]+"), lambda m: len(m[0]) >= 32),
}


def base_by_force(text):
    kinds = list(BASE)
    return sorted(((m.start(), m.end(), k) for k, (p, ok) in BASE.items() for m in p.finditer(text) if ok(m)), key=lambda s: (s[0], kinds.index(s[2])))


def test_base_spans_of_random_texts():
    random.seed(4)
    bits = ["password", "PASSWD", "api_key", "ſecret", "toKen", "=", ":", " ", '"', "'", "abc12345", "AKIA", "ABCDEFGHIJKL99", "deadbeef" * 4, "0f", "x", "\n", "é", "AKIAAKIA"]
    for _ in range(3000):
        text = "".join(random.choice(bits) for _ in range(random.randint(0, 14)))
        assert secrets.base_spans(text) == base_by_force(text), text


@pytest.mark.parametrize(
    "text,found",
    [
        ('db_password = "hunter2-Very9Long"', ["hunter2-Very9Long"]),
        ('K = "zX9$kLm2Qp7!vB"\nauthToken = K', ["zX9$kLm2Qp7!vB"]),
        ('a = "abcD1234"\nsecret_key = a + "Efgh5678"', ["abcD1234", "Efgh5678"]),
        ("clientCredential: tR7xQ9wLp2Zk!", ["tR7xQ9wLp2Zk!"]),
        ('{"private_key": "MIIEvQ8x7Yz01"}', ["MIIEvQ8x7Yz01"]),
        ('password_length = "12345678abc"', []),
        ('title = "zX9kLm2Qp7vBaa"', []),
        ('password = "changeme"', ["changeme"]),
        ("The token: of the realm is here.", []),
        ('// secret_key = "abcD1234Efgh"\nname = "x"', []),
    ],
)
def test_lexed_assignments(text, found):
    base, spans = secrets.all_spans(text)
    values = [secrets.ASSIGN.match(text, a)[1] if kind == "assign" else text[a:b] for a, b, kind in spans]
    assert values == found


@pytest.mark.parametrize(
    "text,found",
    [
        ('secret_key = "tR7xQ9" + "wLp2Zk" + "mB4d"', ["tR7xQ9", "wLp2Zk", "mB4d"]),
        ('a = "tR7xQ9wL"\nb = "p2Zk"\nsecret_key = a + b + ""', ["tR7xQ9wL", "p2Zk"]),
        ('auth_header = "Bearer is " + "tR7xQ9wLp2ZkmB4d"', ["tR7xQ9wLp2ZkmB4d"]),
        ('title = "tR7xQ9" + "wLp2Zk" + "mB4d"', []),
    ],
)
def test_joined_literals_are_scored_as_one_value(text, found):
    assert [text[a:b] for a, b, _ in secrets.literal_spans(text)] == found


@pytest.mark.parametrize("name", ["pass_phrase", "pass_word", "api_salt", "access_signature", "pass-wd", '"pass word"', "Pass.Phrase"])
def test_any_name_that_scores_is_lexed(name):
    assert [s[2] for s in secrets.literal_spans(f'{name} = "tR7xQ9wLp2ZkmB4d"')] == ["literal"]


def test_gated_and_ungated_scans_are_equal(monkeypatch):
    random.seed(6)
    parts = ["pass", "word", "phrase", "api", "salt", "access", "signature", "Key", "au", "th", "to", "ken", "_", "-", ".", " ", "é", "\n", "title", '"', "\\"]
    texts = ["".join(random.choices(parts, k=random.randint(1, 6))) + random.choice([" = ", ": ", ":="]) + '"tR7xQ9wLp2ZkmB4d"' for _ in range(4000)]
    gated = [secrets.literal_spans(t) for t in texts]
    monkeypatch.setattr(secrets, "may_name", lambda text: True)
    assert gated == [secrets.literal_spans(t) for t in texts] and any(gated)


def test_scan_and_redact(odd, none, spark):
    rows, docs = odd
    got = {r.doc_id: r for r in secrets.scan_secrets(docs, mark="#").collect()}
    assert got[1].n_assign == 0 and got[1].spans == "" and got[1].base_sha256 == hashlib.sha256(b"").hexdigest()
    assert got[15].n_hex == 1 and got[15].redacted == "#"
    assert secrets.scan_secrets(none).count() == 0 and secrets.redact_secrets(none).count() == 0
    one = spark.createDataFrame([(1, "my api_key = 'Abcdefgh1' ok", 27)], "doc_id long, text string, n_chars long")
    assert [tuple(r) for r in secrets.redact_secrets(one).collect()] == [(1, "my api_key = '[SECRET]' ok", 26)]


# quality rules


def quality_by_force(k, text):
    t = text or ""
    words = re.findall(WORDS, t)
    lines = [x for x in t.split("\n") if re.search(WORDS, x)]
    grams = collections.Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    covered = {j for i in range(len(words) - 4) if grams[tuple(words[i : i + 5])] > 1 for j in range(i, i + 5)}
    n = len(words)
    return (k, n, sum(map(len, words)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(covered), n < 10 or 100 * len(covered) > 20 * n)


def test_quality_counts(spark, odd, none):
    rows, docs = odd
    got = quality.quality_report(docs, Scratch(spark)).collect()
    assert sorted((tuple(r)[:7] for r in got), key=keyed) == sorted((quality_by_force(*r) for r in rows), key=keyed)
    assert not any(r.kept for r in got if r.base_failed)
    assert quality.quality_report(none, Scratch(spark)).count() == 0 and quality.keep_good(none, Scratch(spark)).count() == 0


def test_quality_verdicts(spark):
    prose = " ".join(f"{a}{b}" for k, a in enumerate(["some", "plain", "words", "that", "follow"]) for b in ["", "er", "ing", "ed", "ly", "ness", "ful", "ish"])
    texts = [prose, prose.upper(), prose.replace(" ", "*** "), prose.replace(" ", "!! "), "ab " * 40, "\n".join(["same line here again"] * 9), prose.replace(" ", "")]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert [r.kept for r in quality.quality_report(docs, Scratch(spark)).orderBy("doc_id").collect()] == [True] + [False] * 6
    assert [r.doc_id for r in quality.keep_good(docs, Scratch(spark)).collect()] == [0]


def test_rules_are_ordered_by_rejections_per_cost(spark):
    docs = spark.createDataFrame([(k, "ab " * k) for k in range(30)], "doc_id long, text string")
    rules = (quality.Rule("never", lambda d: d.text == "zz"), quality.Rule("often", lambda d: d.text != "zz"))
    assert [m.rule.name for m in quality.measure(docs, rules, Scratch(spark))] == ["often", "never"]


def test_keep_good_keeps_columns_of_any_name(spark, none):
    prose = " ".join(f"word{k} and others" for k in range(20))
    rows = [(1, prose, 7, "x"), (2, None, 8, "y"), (3, "", 9, None), (None, prose, 1, "z"), (1, prose, 7, "x"), (4, "too short", 2, "w"), (5, prose * 400, 3, "v")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, __d int, __text string")
    got = quality.keep_good(docs, Scratch(spark))
    assert got.columns == docs.columns and sorted(map(tuple, got.collect()), key=keyed) == sorted((r for r in rows if r[1] == prose), key=keyed)
    assert quality.keep_good(none, Scratch(spark)).count() == 0


# media


def test_lzw_round_trip():
    random.seed(6)
    for size, n in [(2, 1), (2, 5000), (3, 40_000), (8, 0), (8, 70_000), (8, 300)]:
        data = bytes(random.choices(range(1 << size), k=n))
        assert media.lzw_decode(media.lzw_encode(data, size), size) == data


def gif(frames, size=(3, 2), palette=b"\0\0\0\xff\0\0\0\xff\0\0\0\xff"):
    out = b"GIF89a" + struct.pack("<HHBBB", *size, 0x81, 0, 0) + palette
    for packed, delay, clear, box, flags, samples in frames:
        out += b"\x21\xf9\x04" + struct.pack("<BHB", packed, delay, clear) + b"\0\x2c" + struct.pack("<HHHHB", *box, flags) + b"\x02" + media._sub_blocks(media.lzw_encode(bytes(samples), 2))
    return out + b"\x3b"


def test_transparency_disposal_and_interlace():
    full, dot = (0, 0, 3, 2), (1, 0, 1, 1)
    frames = list(media.decode_gif(gif([(0, 5, 0, full, 0, [1, 2, 3, 1, 2, 3]), (3 << 2, 5, 0, dot, 0, [3]), (2 << 2 | 1, 5, 3, (0, 0, 2, 1), 0, [3, 1]), (0, 5, 0, dot, 0, [2])])))
    reds = [f.canvas[..., 0].tolist() for f in frames]
    assert reds[0] == [[255, 0, 0], [255, 0, 0]]
    assert frames[1].canvas[0, 1].tolist() == [0, 0, 255, 255]
    assert frames[2].canvas[0].tolist() == [[255, 0, 0, 255], [255, 0, 0, 255], [0, 0, 255, 255]]  # restored, one sample clear
    assert frames[3].canvas[0].tolist() == [[0, 0, 0, 0], [0, 255, 0, 255], [0, 0, 255, 255]]  # cleared, then drawn
    assert [f.delay_ms for f in frames] == [50] * 4 and sum(frames[0].histogram()) == 6
    rows = list(media.decode_gif(gif([(0, 1, 0, (0, 0, 1, 5), 0x40, [0, 1, 2, 3, 1])], size=(1, 5))))[0].canvas
    assert [r[0].tolist()[:3] for r in rows] == [[0, 0, 0], [0, 0, 255], [0, 255, 0], [255, 0, 0], [255, 0, 0]]


def test_damaged_images(spark):
    good = gif([(0, 5, 0, (0, 0, 3, 2), 0, [1, 2, 3, 1, 2, 3])])
    rows = [(1, good), (2, good[:30]), (3, b"PNG"), (4, None), (5, b"")]
    got = {r.key: r for r in media.frame_table(spark.createDataFrame(rows, "k long, image binary"), "k", "image").collect()}
    assert got[1].frame == 0 and got[1].error is None and sum(got[1].histogram) == 6
    assert all(got[k].frame is None and got[k].error for k in (2, 3, 4, 5))


def test_texts_as_media(odd, none):
    rows, docs = odd
    got = sorted(media.examine_media(media.store_texts(docs)).collect(), key=keyed)
    want = []
    for k, t in rows:
        raw = (t or "").encode()
        padded = raw + b"\0" * (-len(raw) % 64 or (0 if raw else 64))
        want.append((k, len(raw), len(padded), hashlib.sha256(padded).hexdigest(), zlib.crc32(padded[-64:])))
    assert [tuple(r)[:5] for r in got] == sorted(want, key=keyed)
    assert media.examine_media(media.store_texts(none)).count() == 0


# language-model scores


def test_gradients():
    w = pseudolm.Weights(*(x.astype(np.float64) for x in pseudolm.Weights.start(1).all()))
    random.seed(1)
    context = np.array([[random.randrange(pseudolm.WORDS + 1) for _ in pseudolm.PLACES] for _ in range(6)])
    target = np.array([random.randrange(pseudolm.WORDS) for _ in range(6)])
    gradients = [np.zeros(x.shape) for x in w.all()]
    pseudolm.log_probabilities(w, context, target, gradients)
    for x, g in zip(w.all(), gradients):
        at = np.unravel_index(np.abs(g).argmax(), g.shape)
        old, step = x[at], 1e-2
        sides = []
        for s in (step, -step):
            x[at] = old + s
            sides.append(-pseudolm.log_probabilities(w, context, target).astype(np.float64).mean())
        x[at] = old
        assert abs((sides[0] - sides[1]) / (2 * step) - g[at]) < 2e-2 * abs(g[at]) + 1e-4


def test_rows_add_up_by_word():
    draw = np.random.default_rng(4)
    for n, kinds in ((1, 1), (7, 3), (5000, 900), (5000, 2)):
        ids = draw.integers(0, kinds, n)
        rows = np.concatenate([draw.integers(-9, 9, (n, 5)), np.zeros((1, 5), int)]).astype(float)
        expected = np.zeros((kinds, 5))
        np.add.at(expected, ids, rows[:n])
        found, sums = pseudolm._sums(rows, ids, np.empty((n + pseudolm._RUN * kinds, 5)))
        assert np.array_equal(found, np.unique(ids)) and np.array_equal(sums, expected[found])


def test_ids_of_words_whose_hashes_begin_alike():
    known = np.sort(np.array([5, 6, 7, 1 << 50, (1 << 50) + 1, (1 << 63) + 9], np.uint64))
    asked = np.array([0, 5, 6, 7, 8, 1 << 50, (1 << 50) + 1, (1 << 50) + 2, (1 << 63) + 9, 2**64 - 1], np.uint64)
    other = pseudolm.KNOWN + asked % np.uint64(pseudolm.MEMBERS)
    assert pseudolm.word_ids(asked, known, np.arange(6)).tolist() == [other[0], 0, 1, 2, other[4], 3, 4, other[7], 5, other[9]]
    assert pseudolm.word_ids(asked, known[:0], known[:0]).tolist() == other.tolist()


def test_probabilities_add_up():
    w = pseudolm.Weights.start(3)
    context = np.tile([[1, 2, 3, 4]], (pseudolm.WORDS, 1))
    assert abs(np.exp(pseudolm.log_probabilities(w, context, np.arange(pseudolm.WORDS))).sum() - 1) < 1e-3


def test_held_out_words_are_better_than_by_frequency_alone(spark):
    random.seed(8)
    follow = {f"w{k}": [f"w{(3 * k + j) % 40}" for j in range(2)] for k in range(40)}

    def text():
        out = ["w0"]
        while len(out) < 200:
            out.append(random.choice(follow[out[-1]]))
        return out

    train, test = [text() for _ in range(150)], [text() for _ in range(10)]
    docs = spark.createDataFrame([(k, " ".join(t)) for k, t in enumerate(train)], "doc_id long, text string").repartition(2)
    known = pseudolm.vocabulary(docs, 1)
    flat = pseudolm.fit(docs, known, rounds=6)
    held = spark.createDataFrame([(k, " ".join(t)) for k, t in enumerate(test)] + [(10 + k, " ".join(random.sample(t, len(t)))) for k, t in enumerate(test)], "doc_id long, text string")
    got = {r.doc_id: r.mean_log_likelihood for r in held.mapInArrow(pseudolm._scored(known, flat), "doc_id long, n_words long, log_likelihood double, mean_log_likelihood double").collect()}
    real, mixed = np.mean([got[k] for k in range(10)]), np.mean([got[k] for k in range(10, 20)])
    assert real > -np.log(40) + 0.8 and real > mixed + 0.8


def test_rare_words_are_scored_as_words(spark):
    random.seed(9)
    texts = [" ".join(f"w{int(random.paretovariate(0.2))}" for _ in range(200)) for _ in range(80)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    hashed = [pseudolm.word_hashes(*as_bytes(pa.array([t])))[0] for t in texts]
    counts = collections.Counter(int(h) for own in hashed for h in own)
    known = pseudolm.vocabulary(docs, 1)
    rare = {h: n for h, n in counts.items() if h not in set(np.array(known, np.int64).view(np.uint64).tolist())}
    totals = collections.Counter()
    for h, n in rare.items():
        totals[h % pseudolm.MEMBERS] += n
    assert len(rare) > 1000
    flat = pseudolm.fit(docs, known)
    alone = {r.doc_id: r.log_likelihood for r in docs.mapInArrow(pseudolm._scored(known, flat), "doc_id long, n_words long, log_likelihood double, mean_log_likelihood double").collect()}
    got = {r.doc_id: r.log_likelihood for r in pseudolm.score(docs).collect()}
    for k, own in enumerate(hashed):
        assert abs(got[k] - alone[k] - sum(np.log(rare[int(h)] / totals[int(h) % pseudolm.MEMBERS]) for h in own if int(h) in rare)) < 0.05


def test_scores_of_odd_documents(odd, none):
    rows, docs = odd
    got = {r.doc_id: r for r in pseudolm.score(docs, rounds=1).collect()}
    assert len(got) == len({k for k, _ in rows}) and got[1].n_words == 0 and got[1].log_likelihood == 0
    assert got[7].log_likelihood == got[8].log_likelihood and got[9].n_words == 30_000
    assert pseudolm.score(none, rounds=1).count() == 0


def test_word_hashes_ignore_ascii_case():
    data, at = as_bytes(pa.array(["The the", "THE", "", "é É"]))
    h, first = jaccard.word_hashes(data, at)
    assert first.tolist() == [0, 2, 3, 3, 5] and h[0] == h[1] == h[2] and h[3] != h[4]
