"""Each operator on a small table of hard cases, against brute force."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import public_tokenizers
from cataloom.llm import bpe, components, edits, fingerprint, html_extract, langid, line_dedup, ngram_join, packing, quality, sharding, suffix_dedup

DOCS = "doc_id long, text string, lang string, source string, n_chars int, token string, gone string, n_lines string, lang_pred string"
PROSE = "the quick brown fox jumps over the lazy dog while seven wise owls watch from a tall old tree near the river bank"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def prose(seed, n):
    rng = np.random.default_rng(seed)
    return " ".join("".join(rng.choice(list("abcdefghij"), rng.integers(2, 9))) for _ in range(n))


LONG = "\n".join(prose(i, 40) for i in range(300))
TEXTS = [
    PROSE, PROSE, None, "", "  \n\n\t", "one", "a b c d", LONG, LONG.replace("a", "b", 3), "Ünïcödé — 日本語のテキスト 😀 " * 30, "x" * 700, PROSE.upper() + "!!", PROSE + "\n" + PROSE, "### $$$ %%%\n" * 40,
    prose(7, 60) + " " + PROSE + " " + prose(8, 60), prose(9, 50) + " " + PROSE + " " + prose(10, 50), PROSE.replace("seven", "eight") + " 12 34.\nlast line here with more words", "é" * 130 + " tail", "é" * 130 + " other",
]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, ("en", "de", None)[i % 3], "s", 0, "t", "g", "l", "p") for i, t in enumerate(TEXTS)]
    rows += [rows[0], rows[7], (100, TEXTS[14], None, None, None, None, None, None, None)]  # repeated rows, and one with nulls everywhere
    return spark.createDataFrame(rows, DOCS).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="module")
def texts():
    return dict(enumerate(TEXTS)) | {100: TEXTS[14]}


class Union(dict):
    def __missing__(self, k):
        return k

    def find(self, x):
        while self[x] != x:
            x = self[x]
        return x

    def join(self, a, b):
        a, b = self.find(a), self.find(b)
        self[max(a, b)] = min(a, b)


@pytest.fixture(scope="module")
def ranks():
    return bpe.load(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))


def test_bpe_equals_the_library(spark, docs, none, texts, ranks):
    import tiktoken

    own = tiktoken.Encoding(
        "own", pat_str=public_tokenizers.PATTERN,
        mergeable_ranks=bpe.load_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken")), special_tokens={}
    )
    assert ranks.monotone
    out = bpe.encoded(docs, ranks, public_tokenizers.PATTERN, size=20).select(
        "doc_id", "ids", bpe.decoded(F.col("ids"), ranks).alias("raw"), "token"
    )
    rows = out.collect()
    assert len(rows) == len(TEXTS) + 3
    for r in rows:
        t = texts[r.doc_id] or ""
        assert r.ids == own.encode_ordinary(t) and bytes(r.raw) == t.encode() == bpe.Decoder(ranks)(np.array(r.ids, np.int64))
    assert bpe.encoded(none, ranks, public_tokenizers.PATTERN).count() == 0


def test_bpe_query_digests(spark, tmp_path):
    import tiktoken
    from cataloom.llm import queries

    own = tiktoken.Encoding(
        "own", pat_str=public_tokenizers.PATTERN,
        mergeable_ranks=bpe.load_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken")), special_tokens={}
    )
    spark.createDataFrame(
        [(i, t, 0, "x") for i, t in enumerate(TEXTS)], "doc_id long, text string, n_tokens int, row string"
    ).write.parquet(f"{tmp_path}/documents.parquet")
    sha = lambda b: hashlib.sha256(b).hexdigest()
    want = {}
    for i, t in enumerate(TEXTS):
        ids = own.encode_ordinary(t or "")
        want[i] = (len(ids), sha(",".join(map(str, ids)).encode()), sha((t or "").encode()))
    assert {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in queries.op1_byte_bpe(spark, str(tmp_path)).collect()} == want


def test_bpe_white_space_and_contractions(spark, ranks):
    import tiktoken

    own = tiktoken.Encoding(
        "own", pat_str=public_tokenizers.PATTERN,
        mergeable_ranks=bpe.load_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken")), special_tokens={}
    )
    hard = [
        "I'll  they've  x\u0085y 　 'S it's\r\n\r\n  z ", "  lead", "trail  ", "12 345½ ²", "a\x01b\x1cc", "<|endoftext|>",
        prose(3, 1) * 40, "zq" * 200, "日本語 １２ ⅷ x² 𝟙𝟚 😀👍🏽 𐍈𐍉", "ÄÖ_ü'll\xa0\u2003x\u200b\u00ad"
    ]
    out = bpe.encoded(spark.createDataFrame(list(enumerate(hard)), "doc_id int, text string"), ranks, public_tokenizers.PATTERN)
    assert {r.doc_id: r.ids for r in out.collect()} == {i: own.encode_ordinary(t) for i, t in enumerate(hard)}
    with pytest.raises(ValueError):
        bpe.java_pattern(r"\p{Lu}+|\s+")


def levenshtein(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, last = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
    return row[-1]


def plain(line):
    return " ".join(re.sub("[A-Z]", lambda m: m[0].lower(), line).split(" "))


def brute_lines(texts):
    """What is left of each text when every line with five words or more is compared with every other one (by the distance that a test below holds against a plain table)."""
    union, place = Union(), {}
    for d in sorted(texts):
        for i, line in enumerate((texts[d] or "").split("\n")):
            words = WORD.findall(re.sub(r"[!-/:-@\[-`{-~]", " ", line))
            if len(words) >= line_dedup.MIN_WORDS:
                place[d, i] = " ".join(WORD.findall(plain(line))), True
            elif WORD.search(line):
                place[d, i] = line, False
    for p in place:
        for q in place:
            if p < q and place[p][1] == place[q][1]:
                x, y = place[p][0], place[q][0]
                most = max(len(x), len(y)) * (100 - line_dedup.PERCENT) // 100 if place[p][1] else 0
                if x == y or abs(len(x) - len(y)) <= most and edits.distance(x, y) <= most:
                    union.join(p, q)
    lines = lambda t: enumerate((t or "").split("\n"))
    return {d: "\n".join(line for i, line in lines(t) if union.find((d, i)) == (d, i)) for d, t in texts.items()}


def test_line_dedup(spark, docs, none, texts):
    rows = {r.doc_id: r for r in line_dedup.deduplicated(docs).collect()}
    want = brute_lines({d: t for d, t in texts.items() if len(t or "") < 3000})
    for d, t in want.items():
        assert (rows[d].text or "") == t, d
    assert rows[1].text == "" and rows[0].text == PROSE and rows[2].text is None and rows[12].text == "" and rows[0].gone == "g"
    assert rows[8].n_lines_removed >= 299
    assert line_dedup.deduplicated(none).count() == 0


def test_fuzzy_lines_are_exactly_the_near_ones(spark):
    base = prose(1, 60)
    variants = [
        base, base.replace(base.split()[3], "zz", 1), base + " extra", prose(2, 60), base.upper() + ".",
        " ".join(base.split()[:30]), "one two three four five", "one two three four fife", "one two three five"
    ]
    docs = spark.createDataFrame(list(enumerate(variants)), "doc_id long, text string")
    found = {r.doc_id: r.text for r in line_dedup.deduplicated(docs).collect()}
    assert found == brute_lines(dict(enumerate(variants)))


def test_lines_with_a_hot_block_meet_in_pairs_of_blocks(spark, monkeypatch):
    passage, rows = prose(31, 40), []
    for k in range(40):
        own = prose(500 + k, 30)
        rows += [passage + " " + own, passage + " " + own.replace(own.split()[5], "qq", 1)]
    docs = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string").repartition(6)
    monkeypatch.setattr(line_dedup, "HOT", 6)
    hot_way = {r.doc_id: r.text for r in line_dedup.deduplicated(docs).collect()}
    monkeypatch.setattr(line_dedup, "HOT", 1)
    hottest = {r.doc_id: r.text for r in line_dedup.deduplicated(docs).collect()}
    want = brute_lines(dict(enumerate(rows)))
    assert want == hot_way
    # Blocks of SimHash bits find all that differ in three bits at most.
    assert len({d for d in want if hottest[d] != want[d]}) <= 8


def test_edit_scripts_are_never_shorter_than_the_distance():
    rng = np.random.default_rng(4)
    for k in range(60):
        x = prose(k, int(rng.integers(5, 90))).split()
        y = [w for w in x if rng.random() > 0.08]
        for at in rng.integers(0, max(len(y), 1), 3):
            y.insert(int(at), prose(900 + int(at), 1))
        x, y = " ".join(x), " ".join(y)
        exact = levenshtein(x, y)
        assert edits.distance(x, y) == exact <= edits.script(x, y, 10**6)
        assert edits.within(x, y, exact) and not edits.within(x, y, exact - 1)
        assert edits.distance(x, y, exact) == exact and edits.distance(x, y, exact - 1) >= exact


def test_similar_is_what_the_distance_says():
    rng, seen = np.random.default_rng(8), Counter()
    for k in range(1500):
        x = prose(int(rng.integers(30)), int(rng.integers(20, 40))).split()
        y = list(x)
        for _ in range(int(rng.integers(0, 9))):
            i, j = rng.integers(len(y)), rng.integers(len(y))
            if k % 3 == 0:
                y[i], y[j] = y[j], y[i]  # words that change places
            elif k % 3 == 1:
                y[i] = y[i][: len(y[i]) // 2] + "z" + y[i][len(y[i]) // 2 :]
            else:
                y.insert(int(j), y.pop(int(i)))
        x, y = " ".join(x), " ".join(y)
        most = max(len(x), len(y)) // 5
        # A test of its own: two rows of the table.
        row = list(range(len(y) + 1))
        for i, c in enumerate(x, 1):
            before, row = row, [i]
            for j, d in enumerate(y, 1):
                row.append(min(before[j] + 1, row[-1] + 1, before[j - 1] + (c != d)))
        near = row[-1] <= most
        assert edits.similar(x, y, 80) == near, (x, y)
        seen[near] += 1
    assert min(seen[True], seen[False]) > 100


def thue_morse(n, flip=False):
    return "".join("ab"[(bin(i).count("1") + flip) % 2] for i in range(n))


def test_long_words_of_two_letters_are_told_apart(spark):
    one, other = thue_morse(2048), thue_morse(2048, True)
    data = np.frombuffer((one + other).encode(), np.uint8)
    names = packing.K.span_hash(packing.K.prefix_hash(data, False), np.array([0, 2048]), np.array([2048, 4096]))
    assert names[0] != names[1]
    docs = spark.createDataFrame([(0, one), (1, other), (2, f"{one} {other}"), (3, one.upper())], "doc_id long, text string")
    assert [r.component_id for r in ngram_join.classes(docs).orderBy("doc_id").collect()] == [0, 1, 2, 0]
    path = public_tokenizers.path("word_bpe_49k.json")
    from tokenizers import Tokenizer

    ids = {r.doc_id: r.ids_crc32 for r in packing.tokenized_pieces(docs, path).collect()}
    for r in docs.collect():
        want = Tokenizer.from_file(path).encode(r.text, add_special_tokens=False).ids + [1]
        assert ids[r.doc_id] == zlib.crc32(np.array(want, "<u4").tobytes())
    texts = {r.doc_id: r.text for r in line_dedup.deduplicated(docs.where("doc_id < 2")).collect()}
    assert texts == {0: one, 1: other}


def test_word_ids_equal_the_library_on_all_kinds_of_letters():
    words = packing.WordIds(public_tokenizers.path("word_bpe_49k.json"))
    rng = np.random.default_rng(2)
    kinds = list("abXYéÉİıßſΣςσñÑ日本ー..,!'\"-—…ǅﬁअ़क़") + ["\u0301", "\u0307", "\u0958", "\u09dc"]
    texts = ["".join(rng.choice(kinds, rng.integers(1, 9))) for _ in range(20000)] + ["DEĞERİ.", "SEVGİ,", "İ!"]
    texts += [form % chr(c) for form in ("a%s.", "%s!") for c in range(0x21, 0x3100) if not chr(c).isspace()]
    texts = [t for t in texts if t.split() == [t]]
    got = [[i for part in words.parts(t.encode()) for i in words.asked([part])[0]] for t in texts]
    assert got == [e.ids for e in words.tokenizer.encode_batch(texts, add_special_tokens=False)]


def test_sharding(spark, docs, none, texts, tmp_path):
    out = sharding.sharded(docs, shards=4, map_path=str(tmp_path / "maps"))
    rows = out.collect()
    assert len(rows) == len(TEXTS) + 3
    for r in rows:
        t = (texts[r.doc_id] or "").encode()
        assert (r.size, r.text_crc32) == (len(t) + 16, zlib.crc32(t))
    places = defaultdict(list)
    for r in rows:
        places[r.shard].append(r.slot)
    assert all(sorted(p) == list(range(len(p))) for p in places.values())
    first = sharding.load_map(spark, str(tmp_path / "maps")).toPandas()
    grown = sharding.rebalanced(first, 5)
    moved = grown.merge(first, on="v_slot", suffixes=("", "_old")).query("shard != shard_old")
    assert set(moved["version"]) <= {2} and set(moved["shard"]) <= {4}
    sharding.store_map(spark, grown, str(tmp_path / "maps"))
    assert sharding.load_map(spark, str(tmp_path / "maps")).first().version == 2
    assert sharding.sharded(none).count() == 0


def shingles(text):
    words = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} if len(words) >= 5 else ({tuple(words)} if words else set())


def near_classes(texts):
    sets, union = {d: shingles(t) for d, t in texts.items()}, Union()
    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b]:
                both = len(sets[a] & sets[b])
                if 100 * both >= 75 * (len(sets[a]) + len(sets[b]) - both):
                    union.join(a, b)
    return {d: (len(s), union.find(d)) for d, s in sets.items()}


def test_ngram_join(spark, docs, none, texts):
    rows = ngram_join.classes(docs).collect()
    assert len(rows) == len(TEXTS) + 3 and {r.doc_id: (r.n_shingles, r.component_id) for r in rows} == near_classes(texts)
    kept = sorted(r.doc_id for r in ngram_join.representatives(docs).collect())
    assert kept == sorted(d for d in [*texts, 0, 7] if near_classes(texts)[d][1] == d)
    assert ngram_join.classes(none).count() == 0


def test_ngram_join_on_a_family_of_near_copies(spark):
    rng, texts = np.random.default_rng(5), {}
    base = prose(11, 150).split()
    for d in range(400):
        words = list(base)
        for at in rng.choice(150, rng.integers(0, 8), replace=False):
            words[at] = f"w{rng.integers(1000)}"
        texts[d] = " ".join(words)
    for d in range(400, 460):
        texts[d] = prose(d, int(rng.integers(3, 80))) + (" " + " ".join(base[:40]) if d % 2 else "")
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(5)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.classes(docs).collect()} == near_classes(texts)


def test_components_of_a_long_path_and_a_star(spark):
    links = [(i, i + 1) for i in range(60)] + [(100, 100 + i) for i in range(1, 50)] + [(7, 7)]
    found = {r.node: r.component for r in components.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert found == {i: 0 for i in range(61)} | {100 + i: 100 for i in range(50)}


def test_quality_counts_and_verdicts(spark, docs, none, texts):
    labels = spark.createDataFrame([(0, 1, 0), (0, 0, 0), (999, 1, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")
    rows = quality.judged(docs, labels).collect()
    assert len(rows) == len(TEXTS) + 3
    for r in rows:
        t = texts[r.doc_id] or ""
        words, lines = WORD.findall(t), [x for x in t.split("\n") if WORD.search(x)]
        runs = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
        covered = {k for i in range(len(words) - 7) if runs[tuple(words[i : i + 8])] > 1 for k in range(i, i + 8)}
        want = (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(covered))
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        assert r.base_failed == (len(words) < 20 or 100 * len(covered) > 30 * len(words)) and r.kept == (not r.base_failed)
    assert quality.judged(none, labels).count() == 0


def test_quality_bounds_are_exact():
    for k, n, error in ((0, 100, 0.05), (3, 50, 0.01), (10, 1000, 0.001)):
        p = quality.upper_bound(k, n, error)
        tail = sum(math.comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k + 1))
        assert abs(tail - error) < 1e-6
    p, q = quality.upper_bound(5000, 200_000, 0.005), quality.upper_bound(40_000, 10**6, 0.005)
    normal = lambda k, n: k / n + 2.5758 * math.sqrt(k / n * (1 - k / n) / n)
    assert abs(p - normal(5000, 200_000)) < 3e-5 and abs(q - normal(40_000, 10**6)) < 1e-5
    good, bad = np.zeros(11, int), np.zeros(11, int)
    good[0], bad[5], bad[10] = 1000, 50, 50
    assert quality.certified_cutoffs(good, bad, 0.02, 0.01) == 4
    assert quality.certified_cutoffs(good // 100, bad, 0.02, 0.01) == 10  # too few labels certify nothing


def test_fingerprints(spark, docs, none, texts):
    rows = sorted(fingerprint.fingerprints(docs).collect(), key=lambda r: r.doc_id)
    assert len(rows) == len(TEXTS) + 3
    order = sorted([*texts, 0, 7])
    for i, r in enumerate(rows):
        own, after = texts[r.doc_id] or "", texts[order[(i + 1) % len(order)]] or ""
        n = len(own)
        edited = own[: n - n // 2] + after[: n // 2]
        assert (r.n_chars, r.edited_sha256) == (n, hashlib.sha256(edited.encode()).hexdigest())
        assert r.fingerprint == fingerprint.as_text(fingerprint.sketch(own)) and 0 <= r.near_edited <= 1
    assert fingerprint.fingerprints(none).count() == 0


def test_sketch_equals_the_definition():
    for text in ("x", "short text", "abab" * 30, prose(6, 60), prose(7, 700), "é日😀" * 9):
        k = min(fingerprint.KMER, len(text))
        seen, numbered = Counter(), []
        for i in range(len(text) - k + 1):
            gram = text[i : i + k]
            points = fingerprint.K.mix(np.array([ord(c) for c in gram], np.uint64))
            h = int(fingerprint.K.window_hash(points, k)[0]) >> 24
            numbered.append(int(fingerprint.K.mix(np.array([(h * int(fingerprint.K.BASE) + seen[gram]) % 2**64], np.uint64))[0]))
            seen[gram] += 1
        want = []
        for factor in fingerprint.FACTORS[:, 0].tolist():
            least = sorted(sorted(range(len(numbered)), key=lambda i: factor * numbered[i] % 2**64)[: fingerprint.TUPLE])
            value = 0x51ED270B
            for i in least:
                value = int(fingerprint.K.mix(np.array([(value * int(fingerprint.K.BASE) + numbered[i]) % 2**64], np.uint64))[0])
            want.append(value % 2**32)
        assert fingerprint.sketch(text).tolist() == want


def test_fingerprint_sees_order_and_edits():
    words = prose(4, 400).split()
    text, half = " ".join(words), " ".join(words[200:] + words[:200])
    s = fingerprint.sketch
    assert fingerprint.likeness(s(text), s(text)) == 1 and fingerprint.likeness(s(""), s("")) == 1 and fingerprint.likeness(s(""), s(text)) == 0
    assert fingerprint.likeness(s(text), s(prose(5, 400))) < 0.2
    assert fingerprint.likeness(s(text), s(half)) < fingerprint.likeness(s(text), s(text + "x"))


PAGES = [
    (
        1,
        "<html><body><nav><a href=x>Menu</a></nav><article><h1>T &amp; x</h1><p>First <b>bold</b>  text,\n here.<p>Second one. It is longer than the first one.</article><footer>&copy; me</footer>",
        "T & x\nFirst bold text, here.\nSecond one. It is longer than the first one."
    ),
    (2, None, ""), (3, "", ""), (4, "<html><body><nav>only</nav></body></html>", ""), (5, "plain text", "plain text"),
    (
        6,
        "<body><div class='sidebar'><p>Side text that is rather long, with commas, and more.</p></div><main><p>Main text, with commas, and a full stop.</p><ul><li>One</li><li>Two</li></ul><form><p>Your name, please.</p></form><div class=comments><p>I like it, a lot, really.</p></div></main><p",
        "Main text, with commas, and a full stop.\nOne\nTwo"
    ),
    (
        7,
        "<div id=c><h2>Head</h2><div><p>Body text, with commas, and more of it.</p><p>Short.</p></div></div><script>var a='<p>no</p>'</script><style>p{}</style><!-- <p>no</p> -->",
        "Head\nBody text, with commas, and more of it.\nShort."
    ),
    (1, "<p>x", "x"),
]


def test_html(spark):
    pages = spark.createDataFrame([(i, "u", h, "extra") for i, h, _ in PAGES], "page_id long, url string, html string, text string")
    rows = html_extract.extract(pages).collect()
    assert sorted((r.page_id, r.text, r.n_chars) for r in rows) == sorted((i, t, len(t)) for i, _, t in PAGES)
    assert html_extract.extract(pages.limit(0)).count() == 0


def removed(texts):
    seen, out = set(), {}
    for d in sorted(texts):
        raw = (texts[d] or "").encode()
        gone = np.zeros(len(raw), bool)
        for s in range(len(raw) - 99):
            if raw[s : s + 100] in seen:
                gone[s : s + 100] = True
            seen.add(raw[s : s + 100])
        out[d] = gone
    return out


def test_suffix_dedup(spark, docs, none, texts):
    want = removed(texts)
    rows = suffix_dedup.deduplicated(docs).collect()
    assert len(rows) == len(TEXTS) + 3
    for r in rows:
        raw, gone = np.frombuffer((texts[r.doc_id] or "").encode(), np.uint8), want[r.doc_id]
        spans = int(np.diff(np.concatenate([[0], gone.astype(int)])).clip(0).sum())
        assert (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) == (
            len(raw), int(gone.sum()), spans, hashlib.sha256(raw[~gone].tobytes()).hexdigest()
        )
    short = {r.doc_id: r for r in suffix_dedup.shortened(docs).collect()}
    assert short[1].text == "" and short[0].text == PROSE and short[2].text is None and short[0].gone == "g"
    assert suffix_dedup.deduplicated(none).count() == 0


def test_suffix_dedup_around_edits(spark):
    rng, base = np.random.default_rng(3), prose(21, 120)
    texts = {}
    for d in range(60):
        chars = list(base)
        for at in rng.choice(len(chars), rng.integers(0, 6), replace=False):
            chars[at] = "Z"
        a = int(rng.integers(0, 200))
        texts[d] = prose(d, 10) + "".join(chars[a : a + int(rng.integers(90, 500))]) + prose(100 + d, 5)
    texts[60] = "ab" * 400
    texts[61] = "ab" * 60
    want = removed(texts)
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(7)
    found = {r.doc_id: (r.n_removed, r.kept_sha256) for r in suffix_dedup.deduplicated(docs).collect()}
    assert found == {
        d: (int(g.sum()), hashlib.sha256(np.frombuffer(texts[d].encode(), np.uint8)[~g].tobytes()).hexdigest()) for d,
        g in want.items()
    }


def test_suffix_dedup_with_zero_bytes(spark):
    text = prose(41, 80)[:300]
    texts = {0: text, 1: "\0" + text[:120] + "XYZ", 2: text[200:] + "\0" * 130, 3: "\0" * 105}
    found = {
        r.doc_id: (r.n_removed, r.n_spans) for r in suffix_dedup.deduplicated(
            spark.createDataFrame(list(texts.items()), "doc_id long, text string")
        ).collect()
    }
    assert found == {d: (int(g.sum()), int(np.diff(np.concatenate([[0], g.astype(int)])).clip(0).sum())) for d, g in removed(texts).items()}


def test_language_id(spark, docs, none):
    rows = langid.identify(docs).collect()
    assert len(rows) == len(TEXTS) + 3
    for r in rows:
        t = TEXTS[r.doc_id] if r.doc_id < 100 else TEXTS[14]
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1
        assert (r.lang_pred == "und") == (t is None or not any(c.isalpha() for c in t))
    assert {r.lang_pred for r in langid.accepted(docs).collect()} <= {"p", None}  # a clashing column keeps its own values
    assert langid.identify(none).count() == 0


def test_language_id_tells_held_out_languages(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    out = langid.identify(docs).where("held_out").join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert sum(r.lang == r.lang_pred for r in out) / len(out) > 0.98


def brute_code_length(train, text, classes):
    """Bits of a text's bytes under escape C with exclusion, symbol by symbol, from the definition."""
    order, seen = langid.ORDER, defaultdict(Counter)
    padded = [0] * order + [int(classes[b]) for b in train]
    for i in range(order, len(padded)):
        for k in range(order + 1):
            seen[tuple(padded[i - k : i])][padded[i]] += 1
    raw = np.bincount(np.frombuffer(train, np.uint8), minlength=256) + 0.5
    bits, padded = 0.0, [0] * order + [int(classes[b]) for b in text]
    for i in range(order, len(padded)):
        out, share = set(), 1.0
        for k in range(order, -1, -1):
            found = seen[tuple(padded[i - k : i])]
            total, kinds = sum(found.values()), len(found)
            own = {s: c for s, c in found.items() if s not in out}
            if not total:
                continue
            escape = 0.0 if kinds == langid.SYMBOLS else kinds / (total + kinds)
            # What longer contexts have seen is left out, and the rest shares its probability.
            left = sum(own.values()) / total * (1 - escape) + (escape if kinds < langid.SYMBOLS else 0)
            if padded[i] in own:
                share *= own[padded[i]] / total * (1 - escape) / left
                break
            share *= escape / left
            out |= set(found)
        else:
            share /= langid.SYMBOLS - len(out)
        byte = text[i - order]
        bits -= math.log2(share) + math.log2(raw[byte] / raw[classes == classes[byte]].sum())
    return bits


def test_scores_are_code_lengths_of_bytes(spark):
    train, other = (PROSE + " " + prose(3, 30)).encode(), prose(4, 40).encode()
    rows = [(1, train.decode(), "aa"), (2, other.decode(), "bb")]
    model = langid.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert model.languages == ["aa", "bb"]
    for text in (b"the lazy dog", "Über naïve FOX, 42!".encode(), prose(5, 20).encode()):
        data = np.frombuffer(text, np.uint8)
        own = model.sums([(data, np.array([0, len(data)]))])[0][0]
        want = [brute_code_length(t, text, model.classes) for t in (train, other)]
        assert np.allclose(own, want, atol=0.002 * len(text)), (text, own, want)


def test_code_lengths_are_those_of_a_distribution():
    code, n = np.unique(
        langid.codes(np.frombuffer(PROSE.encode(), np.uint8), np.array([0, len(PROSE)]), (np.arange(256) % 64).astype(np.uint8)),
        return_counts=True
    )
    row, steps = langid.code_lengths(code, n)
    assert np.allclose((2.0 ** -(steps / langid.UNIT)).sum(1), 1, atol=1e-2) and row.max() == len(steps) - 1


def test_packing(spark, docs, none, texts):
    from tokenizers import Tokenizer

    path, capacity = public_tokenizers.path("word_bpe_49k.json"), 256
    own = Tokenizer.from_file(path)
    rows = packing.pack_documents(docs, path, capacity).collect()
    found = Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows)
    want = Counter()
    for d in [*texts, 0, 7]:
        ids = [*own.encode(texts[d] or "", add_special_tokens=False).ids, 1]
        for k in range(0, len(ids), capacity):
            part = ids[k : k + capacity]
            want[d, k // capacity, k, len(part), zlib.crc32(np.asarray(part, "<u4").tobytes())] += 1
    assert found == want
    by = defaultdict(list)
    for r in rows:
        by[r.sequence_id].append((r.offset, r.length))
    for items in by.values():
        at = 0
        for offset, length in sorted(items):
            assert offset == at
            at += length
        assert at <= capacity
    assert packing.pack_documents(none, path, capacity).count() == 0


def test_packing_takes_special_tokens_as_the_library_does(spark):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    own = Tokenizer.from_file(path)
    texts = ["<|endoftext|> z", "a<|endoftext|>b. <|ENDOFTEXT|> x<|startoftext|>.", "<|endoftext|", "É. ÉÉ<|EndOfText|>"]
    rows = packing.pack_documents(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), path).collect()
    want = {i: np.asarray([*own.encode(t, add_special_tokens=False).ids, 1], "<u4") for i, t in enumerate(texts)}
    assert {r.doc_id: (r.length, r.ids_crc32) for r in rows} == {i: (len(x), zlib.crc32(x.tobytes())) for i, x in want.items()}


def test_plan_is_best_fit_over_counts():
    rng = np.random.default_rng(1)
    histogram = {int(k): int(rng.integers(0, 50)) for k in range(1, 101)}
    rows = packing.plan(histogram, 100)
    fill, seen = Counter(), Counter()
    for length, first, number, sequence, offset in rows:
        assert first == seen[length]
        seen[length] += number
        for i in range(number):
            assert fill[sequence + i] == offset
            fill[sequence + i] += length
    assert seen == Counter({k: v for k, v in histogram.items() if v}) and max(fill.values()) <= 100
    # As many sequences as best fit decreasing opens when it takes pieces one by one.
    rooms = []
    for length in sorted(histogram, reverse=True):
        for _ in range(histogram[length]):
            fits = [(room, i) for i, room in enumerate(rooms) if room >= length]
            if fits:
                rooms[min(fits)[1]] -= length
            else:
                rooms.append(100 - length)
    assert len(fill) == len(rooms)


def test_short_lines_go_only_as_exact_copies_and_digits_and_marks_count(spark):
    lines = [
        "Short line", "Short line", "short line", "私は猫です。", "私は猫です。", "", " ", "", "---", "---", "12 34 56 78 90",
        "98 76 54 32 10", "12  34 56 78 90", "for i in a [ i ] + = 1", "for i in a [ i ] + = 1"
    ]
    found = line_dedup.deduplicated(
        spark.createDataFrame([(1, "\n".join(lines[:7])), (2, "\n".join(lines[7:]))], "doc_id long, text string")
    ).collect()
    assert {r.doc_id: r.text for r in found} == {
        1: "Short line\nshort line\n私は猫です。\n\n ", 2: "\n---\n12 34 56 78 90\n98 76 54 32 10\nfor i in a [ i ] + = 1"
    }


def test_fuzzy_lines_of_every_length_are_found(spark):
    rng, rows = np.random.default_rng(8), []
    for n in (6, 8, 12, 16, 24, 40, 80):
        for k in range(20):
            words = prose(1000 * n + k, n).split()
            at = int(rng.integers(n))
            other = list(words)
            other[at] = "k" * len(words[at])
            if 5 * len(words[at]) <= len(" ".join(words)):  # then the edit similarity is 0.8 or more
                rows.append((2 * len(rows), n, " ".join(words), " ".join(other)))
    docs = spark.createDataFrame([x for i, _, a, b in rows for x in ((i, a), (i + 1, b))], "doc_id long, text string")
    gone = {r.doc_id for r in line_dedup.deduplicated(docs).where("n_lines_removed = 1").collect()}
    total, found = Counter(n for _, n, _, _ in rows), Counter(n for i, n, _, _ in rows if i + 1 in gone)
    assert all(i % 2 for i in gone) and all(found[n] >= 0.9 * total[n] for n in total), (found, total)


def test_ngram_group_bound_holds_for_every_size(spark):
    for percent in (75, 80):
        n, m = spark.range(1, 181).select(F.col("id").alias("n")), spark.range(1, 242).select(F.col("id").alias("m"))
        pairs = n.join(m, ngram_join._sizes_fit("n", "m", percent)).select("n", "m", ngram_join.least_overlap("n", "m", percent).alias("x"))
        own = {(r.n, r.m): r.x for r in pairs.collect()}
        ends = n.join(m.withColumnRenamed("m", "low"), ngram_join._sizes_fit("n", "low", percent)).join(
            m.withColumnRenamed("m", "high"), ngram_join._sizes_fit("n", "high", percent) & (F.col("low") <= F.col("high"))
        )
        for r in ends.where("n > 90 or n < 30").where("n % 3 = 1").select(
            "*", ngram_join.least_overlap_between("n", "low", "high", percent).alias("x")
        ).collect():
            assert 1 <= r.x <= min(own[r.n, k] for k in range(r.low, r.high + 1))


def test_ngram_link_into_a_group_of_uneven_bounds(spark):
    # 10 common prefix shingles are enough for sizes 100 and 103, but 11 are needed at both ends of the group's sizes.
    rows = [(t, 1, 100) for t in range(10)] + [(t, 2, 103) for t in range(10)] + [
        (t, s, n) for t in (50, 51) for s, n in ((2, 103), (3, 100), (4, 104))
    ]
    postings = spark.createDataFrame(rows, "token long, set_id long, n int")
    groups = spark.createDataFrame([(2, 2), (3, 2), (4, 2)], "node long, component long")
    assert {(r.a, r.b) for r in ngram_join._between_groups(postings, groups, 75).collect()} == {(1, 2)}


def test_language_id_learns_every_language(spark):
    letters = ["abcd", "efgh", "ijkl", "mnop", "qrst", "uvwx", "yzab", "cegi", "dfhj", "klqz", "muxy"]
    rows = [
        (
            100 * k + i, " ".join("".join(np.random.default_rng(100 * k + i).choice(list(x), (12, 5))[j]) for j in range(12)),
            f"l{k:02d}"
        ) for k,
        x in enumerate(letters) for i in range(12 - k // 2)
    ]
    out = langid.identify(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()
    want = {i: lang for i, _, lang in rows}
    assert len(out) == len(rows) and all(r.lang_pred == want[r.doc_id] and 0 < r.score <= 1 for r in out)


def test_html_keeps_every_part_of_the_article():
    s = "A long sentence, with commas, and more of it. "
    one, two = (s * 13).strip(), (s * 7).strip()
    for page in (
        f"<body><div><p>{one}</p></div><div><p>{two}</p></div></body>",
        f"<main><article><p>{one}</p></article><section><p>{two}</p></section></main>",
        f"<div class='has-sidebar nav-open'><p>{one}</p><p>{two}</p></div>",
        f"<article class='post has-comments'><p>{one}</p><p>{two}</p></article>",
        f"<div class='widget'><p>{one}</p><p>{two}</p></div>"
    ):
        assert html_extract.main_text(page) == one + "\n" + two
    assert html_extract.main_text(f"<body><div><p>{one}</p></div><div class='sidebar'><p>{two}</p></div></body>") == one


def test_html_of_any_depth_takes_time_in_proportion():
    import time

    text = "A sentence, with a comma and a full stop."
    for tag in ("div", "span", "ul", "b", "p", "li", "section"):
        n = 60_000
        began = time.time()
        assert text in html_extract.main_text(f"<{tag}>" * n + f"<p>{text}</p>" + f"</{tag}>" * n)
        assert html_extract.main_text(f"<{tag}>" * n + "</i>" * n + f"<p>{text}</p>") == text
        assert time.time() - began < 20


def test_html_ratios_decide_without_any_mark():
    s = "A long sentence, with commas, and more of it. " * 5
    links = "".join(f"<li><a href=x>Link {i}</a></li>" for i in range(30))
    page = f"<body><div class=a><ul>{links}</ul></div><div class=b><h1>Title</h1><p>{s}</p><p>Short.</p><p>{s}</p></div><div class=c><span>Imprint</span></div></body>"
    assert html_extract.main_text(page) == "\n".join(["Title", s.strip(), "Short.", s.strip()])
    # A main element that holds little of it isn't the article.
    page = f"<body><main><p>Ok.</p></main><div><p>{s}</p><p>{s}</p></div></body>"
    assert html_extract.main_text(page) == "\n".join([s.strip(), s.strip()])


def lines_of_a_passage(spark):
    """Documents of a line each, and the ids of those that stay: many are near a leader whose edits are too many, and similar to others that left the bucket with it."""
    passage, rows = prose(91, 14).split(), []
    for k in range(150):
        own, other = passage.copy(), prose(7000 + k, 40).split()
        for i in range(3 + k % 3):
            own[(5 * k + 3 * i) % len(own)] = other[i]
        rows.append(" ".join(own))
    docs = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string").repartition(3)
    found = line_dedup.occurrences(docs)
    lines = {r.doc: (r.text_id, np.array([r.sim]).view(np.uint64), set(r["keys"])) for r in found.collect()}
    union = Union()
    for i, (x, sim_x, keys_x) in lines.items():
        for j, (y, sim_y, keys_y) in lines.items():
            if i < j and keys_x & keys_y and line_dedup.apart(sim_x, sim_y)[0] < 64 and edits.similar(rows[i], rows[j], line_dedup.PERCENT):
                union.join(i, j)
    return docs.withColumn("n_chars", F.length("text")), {i for i in lines if union.find(i) == i}


def test_line_groups_hold_every_link_of_a_block(spark):
    docs, want = lines_of_a_passage(spark)
    got = {r.doc_id for r in line_dedup.deduplicated(docs).where("n_lines_removed = 0").collect()}
    assert got == want and 1 < len(want) < docs.count()


def test_the_pipeline_loses_no_link_of_a_block(spark):
    import corpus_pipeline

    docs, want = lines_of_a_passage(spark)
    assert {r.doc_id for r in corpus_pipeline.fuzzy_line_dedup(spark, docs, "").collect()} == want


def test_cells_of_a_block_hold_every_pair(spark, monkeypatch):
    monkeypatch.setattr(line_dedup, "CELL", 3)
    test_line_groups_hold_every_link_of_a_block(spark)


def test_edits_of_many_pairs_are_those_of_each(monkeypatch):
    monkeypatch.setattr(edits, "FEW", 2)
    some, x, y = random.Random(5), [], []
    for k in range(600):
        text = "".join(some.choice(("ab", "abcdefgh ", "\u6f22\u5b57b", "\U0001d538a")[k % 4]) for _ in range(some.choice((0, 1, 63, 64, 65, 130, 400))))
        other = list(text)
        for _ in range(some.randrange(max(2, len(text) // 3))):
            at = some.randrange(len(other) + 1)
            other[at : at + some.randrange(2)] = some.choice(["", "z", "yz"])
        x.append(text)
        y.append("".join(other))
    want = [edits.distance(a, b) <= edits.most_edits(a, b, 80) for a, b in zip(x, y)]
    assert edits.all_similar(x, y, 80).tolist() == want and 100 < sum(want) < 590


def test_joining_word_tables_takes_little_more_than_the_tables():
    import tracemalloc

    from cataloom.llm import kernels as K

    sizes, hashes = np.full(200_000, 16), np.random.default_rng(3).permutation(200_001).astype(np.uint64)
    one = K.IdTable.of(hashes[:-1], sizes, np.repeat(hashes[:-1], 16).astype(np.uint32))
    other = K.IdTable.of(hashes[-1:], np.array([1]), hashes[-1:].astype(np.uint32))
    tracemalloc.start()
    both = one.joined(other)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    begin, size = both.spans(np.arange(len(both.hashes)))
    assert (both.ids == np.repeat(both.hashes, size)).all() and begin[-1] + size[-1] == len(both.ids)
    assert peak < 5 * both.ids.nbytes


def test_few_pairs_of_a_passage_are_compared(spark):
    """Lines that share a run of words and differ too much for a link: their letters tell, before their texts are fetched. No link is lost."""
    docs, _ = lines_of_a_passage(spark)
    short = [f"{prose(300 + k, 5)} one run of words {prose(600 + k, 6)}" for k in range(120)]
    docs = docs.select("doc_id", "text").union(spark.createDataFrame([(1000 + k, x) for k, x in enumerate(short)], "doc_id long, text string"))
    found = line_dedup.occurrences(docs)
    lines = {r.text_id: (r.doc, np.array([r.sim]).view(np.uint64), set(r["keys"])) for r in found.collect()}
    texts, near, links = {r.doc_id: r.text for r in docs.collect()}, set(), set()
    for x, (i, sim_x, keys_x) in lines.items():
        for y, (j, sim_y, keys_y) in lines.items():
            if x < y and keys_x & keys_y and line_dedup.apart(sim_x, sim_y)[0] < 64:
                near.add((x, y))
                if edits.similar(texts[i].lower(), texts[j].lower(), line_dedup.PERCENT):
                    links.add((x, y))
    none = spark.createDataFrame([], "a long, b long")
    _, shared = line_dedup.candidates(found)
    got = {tuple(r) for r in line_dedup.left_pairs(found, shared, none.toDF("node", "component"), none).collect()}
    assert links <= got < near and links


def test_letters_never_deny_a_link():
    some, texts = random.Random(8), []
    for k in range(300):
        words = ["".join(some.choice("abcXYZ09.,äд漢\U0001d538") for _ in range(some.randrange(1, 9))) for _ in range(some.randrange(5, 60))]
        other = list("  ".join(words))
        for _ in range(some.randrange(len(other) // 5 + 2)):
            at = some.randrange(len(other))
            other[at : at + some.randrange(2)] = some.choice(["", "z", "yß", " "])
        texts += [" ".join(words) + " \t", " " + "".join(other)]
    texts += [" ".join(["e" * 30] * 40), " ".join(["e" * 30] * 33), " ".join(["ab"] * 40_000), " ".join(["ab"] * 30_000)]
    raw = [x.encode() for x in texts]
    lines = line_dedup.Lines(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)]))
    counts = line_dedup.letter_counts(lines, np.arange(len(texts)))
    lower = [" ".join(re.split(r"[ \t]+", re.sub("[A-Z]", lambda m: m[0].lower(), x).strip(" \t"))) for x in texts]
    assert [int(n) for n in counts[:, -2:].copy().view("<u2").ravel()] == [min(len(x), 65535) for x in lower]
    may = line_dedup.few_edits(counts[::2], counts[1::2])
    for i in np.flatnonzero(~may):
        assert edits.distance(lower[2 * i], lower[2 * i + 1]) > edits.most_edits(lower[2 * i], lower[2 * i + 1], line_dedup.PERCENT)
    assert 20 < may.sum() and not line_dedup.few_edits(counts[:1], counts[2:3])[0]


def test_cells_give_the_links_that_join_groups_and_not_their_pairs(spark):
    docs, want = lines_of_a_passage(spark)
    found = line_dedup.occurrences(docs)
    none = spark.createDataFrame([], "a long, b long")
    _, shared = line_dedup.candidates(found)
    lines = line_dedup.block_lines(found, shared)
    texts = line_dedup.line_texts(docs, lines.select("text_id"))
    got = line_dedup.left_pairs(lines, shared, none.toDF("node", "component"), none, texts).collect()
    pairs = line_dedup.left_pairs(found, shared, none.toDF("node", "component"), none).count()
    text, doc = {r.text_id: r.text for r in texts.collect()}, {r.text_id: r.doc for r in found.collect()}
    union = Union()
    for a, b in got:
        assert edits.similar(text[a], text[b], line_dedup.PERCENT)
        union.join(doc[a], doc[b])
    assert {i for i in doc.values() if union.find(i) == i} == want
    # A task gives less than a row for each of its lines; four tasks run.
    assert 0 < len(got) < 4 * len(doc) and len(got) < pairs / 2


def test_cells_are_whole_wherever_batches_are_cut():
    import pyarrow as pa

    rows = pa.RecordBatch.from_arrays([pa.array(np.repeat([3, 5, 6, 9], [4, 1, 7, 2])), pa.array(np.arange(14))], ["cell", "row"])
    for size in (1, 2, 3, 4, 5, 13, 14):
        out = list(line_dedup.whole_cells(iter([rows.slice(0, 0), *(rows.slice(i, size) for i in range(0, 14, size))])))
        cells = [set(x.column("cell").to_pylist()) for x in out]
        assert [r for x in out for r in x.column("row").to_pylist()] == list(range(14))
        assert sum(map(len, cells)) == len(set().union(*cells)) == 4


def test_edits_of_far_pairs_and_of_many_letters(monkeypatch):
    some, x, y = random.Random(6), [], []
    for k in range(400):
        letters = "ab \u6f22" if k % 2 else "".join(map(chr, range(0x4E00, 0x4E00 + 500)))
        text = "".join(some.choice(letters) for _ in range(some.randrange(60, 700)))
        at = some.randrange(len(text))
        far = "".join(some.choice(letters) for _ in range(at))
        x.append(text)
        y.append(far + text[at:] if k % 4 < 2 else text[:at // 4] + far[: at // 5] + text[at // 2 :])
    want = [edits.distance(a, b) <= edits.most_edits(a, b, 80) for a, b in zip(x, y)]
    monkeypatch.setattr(edits, "FEW", 2)
    assert edits.all_similar(x, y, 80).tolist() == want and 20 < sum(want) < 380
    monkeypatch.setattr(edits, "DENSE", 0)
    assert edits.all_similar(x, y, 80).tolist() == want


def test_lines_found_once_and_in_no_group_are_not_joined(spark, monkeypatch):
    rows = [f"{prose(8000 + k, 12)}\n{prose(9000 + k, 12)}" for k in range(200)]
    rows += [rows[3].split("\n")[0], rows[5].replace(rows[5].split()[2], "zz", 1)]
    docs, made = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string"), {}
    write = line_dedup.materialize

    def written(df, name, *more):
        made[name] = write(df, name, *more)
        return made[name]

    monkeypatch.setattr(line_dedup, "materialize", written)
    gone = {r.doc: sorted(r.gone) for r in line_dedup.removed_lines(docs).collect()}
    assert gone == {200: [0], 201: [0, 1]}
    # Three groups of two lines; the others are as many as the filter lets pass.
    assert made["lines"].count() == 403 and 6 <= made["line-places"].count() < 12


def test_leaders_of_small_buckets_take_close_lines_alone(spark):
    """Pairs that aren't close are seldom links, and the cells compare them: they aren't compared twice."""
    docs, _ = lines_of_a_passage(spark)
    copies = [(1000 + k, f"{prose(40 + k % 5, 30)}{'.' * (k // 5 + 1)} {k}") for k in range(20)]
    found = line_dedup.occurrences(docs.select("doc_id", "text").union(spark.createDataFrame(copies, "doc_id long, text string")))
    sim = {r.text_id: np.array([r.sim]).view(np.uint64) for r in found.collect()}
    bits = [line_dedup.apart(sim[a], sim[b])[0] for a, b in line_dedup.candidates(found)[0].collect()]
    assert bits and max(bits) <= line_dedup.CLOSE


def test_leaders_of_large_buckets_take_near_lines():
    """Thousands of lines that differ in numbers are near and not close: each goes with two leaders at most, so pairs stay in proportion to the lines."""
    n, some = 4 * line_dedup.FEW_LINES, np.random.default_rng(4)
    sim = np.full(n, (1 << 62) + 64, np.uint64)
    for _ in range(6):
        sim ^= np.uint64(1) << some.integers(8, 64, n).astype(np.uint64)
    a, b, left = line_dedup.led(np.zeros(n, np.int64), np.arange(n), sim.view(np.int64))
    assert (line_dedup.apart(sim[a], sim[b]) < 64).all() and n / 2 < len(set(b.tolist())) and len(a) <= line_dedup.LEADERS * n and len(left[0]) < n / 2


def test_runs_of_pairs_are_few(monkeypatch):
    """Pairs of one task, of many lengths: each run of them costs the same calls for every letter, so there are few of them."""
    some, runs = random.Random(12), []
    x = ["".join(some.choice("abcdefgh ") for _ in range(int(30 * 1.0045**k))) for k in range(800)]
    y = ["z" + "".join(some.choice("abcdefgh ") if some.random() < 0.1 else c for c in t) + "z" for t in x]
    of = edits._distances
    monkeypatch.setattr(edits, "_distances", lambda a, b, most: runs.append(len(a)) or of(a, b, most))
    got = edits.all_similar(x, y, 80)
    assert len(runs) < 9 and sum(runs) > 700 and got[::40].tolist() == [edits.similar(a, b, 80) for a, b in zip(x[::40], y[::40])]


def test_a_filter_is_packed_by_its_tasks(spark):
    from cataloom.llm import bloom

    keys = np.random.default_rng(9).integers(-(1 << 63), 1 << 63, 5000)
    table = spark.createDataFrame([(int(k),) for k in keys], "key long").repartition(5)
    want = np.zeros(bloom.BITS, bool)
    for at in bloom._slots(keys, bloom.BITS):
        want[at] = True
    got = bloom.build(table, bloom.BITS)
    assert (np.unpackbits(got, bitorder="little").view(bool) == want).all() and bloom.may_hold(got, keys).all()
    assert not bloom.build(table.where("key is null")).any()
