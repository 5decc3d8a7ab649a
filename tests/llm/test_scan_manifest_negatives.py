"""License scans, Merkle manifests and hard negatives against brute force on small tables of hard cases."""

import hashlib
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from cataloom.llm import hard_negatives, license_scan, merkle

WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
DOCS = "doc_id long, text string, lang string, source string, n_chars long, labels string, leaf string, grp string"
MIT = next(m for label, m in license_scan.TEMPLATES if label == "mit-text")
TEXTS = [
    None, "", "Released under the MIT License.", "MIT LICENSE mit-license\nmit\tlicense", "general public general public license", "Licensed under CC BY-NC 4.0. Licensed under CC BY 4.0",
    "This work is licensed under the GNU General Public License, version 3.", "this licensed under the apache license version 2", "lizenz über der Größe — mit license 日本", "under the mit licenses",
    " ".join(w for w in MIT.replace("[including the next paragraph]", "").replace("{noninfringement|non infringement}", "NON-INFRINGEMENT.").replace("{authors|author|*1-6}", "Someone and Sons").replace("{holders|holder}", "holders").split()),
    "word " * 3000 + "Redistribution and use in source and binary forms " * 3, "licensed under " * 400, "\x00mit\x00license\x7f", "a{b} [c] | * mit license",
]


def as_regex(items) -> str:
    """A template's items as a regular expression over words that each end in a space."""
    out = ""
    for x in items:
        if isinstance(x, bytes):
            out += re.escape(x.decode()) + " "
        elif x[0] == "any":
            out += r"(?:\S+ ){%d,%d}" % x[1:]
        else:
            out += "(?:" + "|".join(map(as_regex, x[1])) + ")" + ("?" if x[0] == "optional" else "")
    return out


REGEX = {label: re.compile(r"(?<!\S)" + as_regex(license_scan.parse(markup))) for label, markup in license_scan.TEMPLATES}


def brute(text):
    found = [w.decode() for w in WORD.findall(re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode()))]
    places, base = [], set()
    for phrase, label in license_scan.PHRASES:
        p = phrase.split()
        at = [i for i in range(len(found)) if found[i : i + len(p)] == p]
        places += at
        base |= {label} if at else set()
    line = "".join(w + " " for w in found)
    labels = base | {label for label, r in REGEX.items() if r.search(line)}
    return len(found), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(base)), ",".join(sorted(labels))


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, ("en", "de", None)[i % 3], "s" if i % 2 else None, None if i % 5 == 0 else i, "x", "y", "z") for i, t in enumerate(TEXTS)]
    rows += [rows[2], rows[2], (3, "another text", "en", None, 7, None, None, None), (None, None, None, None, None, None, None, None)]
    return spark.createDataFrame(rows, DOCS).repartition(3)


@pytest.mark.parametrize("piece", [1 << 20, 16])
def test_licenses_equal_brute_force(docs, monkeypatch, piece):
    automaton = license_scan.Automaton(license_scan.TEMPLATES, license_scan.PHRASES)
    monkeypatch.setattr(license_scan, "PIECE", piece)
    for text in TEXTS:
        n, places, spans, score = automaton.scan((text or "").encode())
        at = [p for p, _ in places]
        base = {label for _, label in places}
        labels = ",".join(sorted(base | {x[0] for x in spans}))
        assert (n, len(at), min(at, default=None), max(at, default=None), ",".join(sorted(base)), labels) == brute(text)
        assert 0 <= score <= 1 and (score == 1) == bool(spans)


def test_license_table(docs):
    got = license_scan.scanned(docs).collect()
    assert len(got) == len(TEXTS) + 4
    for r in got:
        text = "another text" if r.doc_id == 3 and r.n_words == 2 else None if r.doc_id is None else TEXTS[r.doc_id]
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels, r.labels) == brute(text)


def test_license_regions_and_spans():
    two = (("a", "start {one|two three} [maybe [so]] end"), ("b", "x {*1-3} y"))
    automaton = license_scan.Automaton(two, (("x y", "xy"),))
    spans = lambda t: automaton.scan(t.encode())[2]
    assert spans("start one end") == [("a", 0, 3)] and spans("Start two three maybe so END") == [("a", 0, 6)]
    assert not spans("start end") and not spans("start one so end") and not spans("start two end")
    assert spans("x y") == [] and spans("x y y") == [("b", 0, 3)] and spans("x 1 2 3 y") == [("b", 0, 5)] and not spans("x 1 2 3 4 y")
    assert automaton.scan(b"q x y x y")[1] == [(1, "xy"), (3, "xy")]
    assert automaton.scan(b"start one")[3] == pytest.approx(2 / 3) and automaton.scan(b"zzz")[3] == 0


def test_license_state_table_is_begun_anew(monkeypatch):
    monkeypatch.setattr(license_scan, "STATES", 2)
    automaton = license_scan.Automaton(license_scan.TEMPLATES, license_scan.PHRASES)
    for text in TEXTS:
        n, places, spans, _ = automaton.scan((text or "").encode())
        assert ",".join(sorted({x for _, x in places} | {x[0] for x in spans})) == brute(text)[-1]


H = lambda s: hashlib.sha256(s.encode()).hexdigest()


def enc(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def climb(digests, run):
    """Levels of a tree, and for each leaf the left and right siblings, one level after the other."""
    levels = [list(digests)]
    while len(levels[-1]) > 1:
        levels.append([H("".join(levels[-1][i : i + run])) for i in range(0, len(levels[-1]), run)])
    paths = []
    for i in range(len(digests)):
        path = []
        for level in levels[:-1]:
            first = i // run * run
            path.append(("".join(level[first:i]), "".join(level[i + 1 : first + run])))
            i //= run
        paths.append(path)
    return levels[-1][0], paths


@pytest.mark.parametrize(("levels", "run"), [(10, 2), (1, 2), (2, 3)])
def test_manifest_equals_brute_force(docs, levels, run):
    leaf = merkle.digest(*map(F.col, merkle.FIELDS))
    other = F.when(F.col("doc_id") % 2 == 0, merkle.digest(F.col("doc_id"), F.col("source"), F.col("lang"), F.col("n_chars") + 1, F.col("text")))
    name = F.when(F.col("lang").isNull(), "").otherwise(F.concat(F.lit("="), "lang"))
    got = merkle.proofs(docs.select(name.alias("grp"), "doc_id", leaf.alias("leaf"), other.alias("tampered")), levels, run).collect()
    groups = {}
    for r in docs.collect():
        groups.setdefault(r.lang, []).append((-1 if r.doc_id is None else r.doc_id, H(enc(r.doc_id) + enc(r.source) + enc(r.lang) + enc(r.n_chars) + enc(r.text)), r))
    names = sorted(groups, key=lambda x: (x is not None, (x or "").encode()))
    trees = [climb([x[1] for x in sorted(groups[n], key=lambda x: x[:2])], run) for n in names]
    root, tops = climb([t[0] for t in trees], run)
    want = []
    for n, (subroot, paths), top in zip(names, trees, tops):
        for (_, digest, r), path in zip(sorted(groups[n], key=lambda x: x[:2]), paths):
            end = digest if r.doc_id is None or r.doc_id % 2 else H(enc(r.doc_id) + enc(r.source) + enc(r.lang) + enc(None if r.n_chars is None else r.n_chars + 1) + enc(r.text))
            for a, b in path + top:
                end = H(a + end + b)
            want.append((r.doc_id, digest, subroot, root, H("".join(a + b for a, b in path + top)), end, end == root))
    key = lambda x: tuple(map(str, x))
    assert sorted(map(tuple, got), key=key) == sorted(want, key=key)
    assert all(r.verified for r in got if r.doc_id is None or r.doc_id % 2)


def test_manifest_of_one_group_and_of_none(docs, spark):
    one = docs.where("doc_id = 4")
    r = merkle.manifest(one).first()
    assert r.leaf == r.subroot == r.root == r.folded_root and r.proof_sha256 == H("") and r.verified
    assert merkle.manifest(docs.where("false")).count() == 0
    assert merkle.manifest(docs.where("lang = 'en'")).select("root").distinct().count() == 1


def test_walk_appends_siblings_while_unwinding():
    digests = [H(str(i)) for i in range(7)]
    root, above = merkle.walk(digests, None)
    assert (root, above) == climb(digests, 2)
    root, above = merkle.walk(digests[:1], 2)
    assert root == H(H(digests[0])) and above == [[("", ""), ("", "")]]
    assert all(merkle.folded(d, p) == climb(digests, 3)[0] for d, p in zip(digests, merkle.walk(digests, None, 3)[1]))


VECTORS = "vec_id long, embedding array<float>, label int, score long, rank int, codes string"


def mined_by_hand(rows):
    usable = {}
    for i, v, label, *_ in rows:
        if i is None or v is None or label is None or any(x is None or not np.isfinite(x) for x in v):
            continue
        entry = (label, [int(np.floor(256 * float(np.float32(x)))) for x in v])
        usable[i] = min(usable.get(i, entry), entry)
    out = []
    for a, (label, v) in usable.items():
        if a % 50:
            continue
        near = sorted(((-sum(x * y for x, y in zip(v, w)), i, k) for i, (k, w) in usable.items() if i != a))
        for s, p, _ in [x for x in near if x[2] == label][:5]:
            fit = [x for x in near if x[2] != label and 50 * -s <= 100 * -x[0] <= 95 * -s][:3]
            out += [(a, p, n + 1, i, -s, -t) for n, (t, i, _) in enumerate(fit)]
    return sorted(out)


def vectors(seed, n, dimensions, scale=1.0):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(4, dimensions))
    rows = []
    for i in range(n):
        v = scale * (centres[rng.integers(4)] + rng.normal(size=dimensions) * 0.7)
        rows.append((i, [float(x) for x in v], int(rng.integers(3)), 0, 0, "c"))
    return rows


@pytest.mark.parametrize(("dimensions", "scale", "at_once"), [(6, 0.1, 1 << 15), (5, 0.1, 3), (4, 1e6, 1 << 15)])
def test_negatives_equal_brute_force(spark, dimensions, scale, at_once):
    rows = vectors(dimensions, 400, dimensions, scale)
    same = rows[50][1]
    rows += [(1000 + i, same, i % 3, 0, 0, None) for i in range(150)]  # a common vector
    rows += [(2000, None, 1, 0, 0, None), (2050, same, None, 0, 0, None), (2100, [float("nan")] * dimensions, 1, 0, 0, None), (2150, [None] * dimensions, 1, 0, 0, None)]
    rows += [(2200, [float("inf")] * dimensions, 1, 0, 0, None), (2250, [], 2, 0, 0, None), (2300, same[:2], 2, 0, 0, None), (2350, [0.0] * dimensions, 0, 0, 0, None), (None, same, 1, 0, 0, None)]
    rows += [rows[100], rows[100], (150, same, 0, 0, 0, None)]
    got = hard_negatives.mined(spark.createDataFrame(rows, VECTORS).repartition(5), at_once=at_once)
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    assert sorted(map(tuple, got.collect())) == mined_by_hand(rows)


def test_negatives_of_nothing(spark):
    assert hard_negatives.mined(spark.createDataFrame([], VECTORS)).count() == 0
    assert hard_negatives.mined(spark.createDataFrame(vectors(1, 1, 3), VECTORS)).count() == 0


def test_bounds_are_rigorous():
    rng = np.random.default_rng(3)
    books = hard_negatives.Codebooks(rng.normal(size=(8, hard_negatives.CODEWORDS, 2)) * 40, 16, "int32", "float64")
    rows, anchors = np.floor(rng.normal(size=(300, 16)) * 100), np.floor(rng.normal(size=(20, 16)) * 100)
    codes, residual = books.encode(rows)
    about = sum(t[:, c] for t, c in zip(books.tables(anchors), codes.T))
    assert (np.abs(about - anchors @ rows.T) <= np.linalg.norm(anchors, axis=1)[:, None] * residual + 1).all()
