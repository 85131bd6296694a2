"""Every operator against brute force on small tables with awkward rows."""

import base64
import hashlib
import io
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as some
from pyspark.sql import functions as F

from tests.llm.conftest import SCHEMA, prose
from tidemark.llm import decontaminate, language, line_dedup, media, mixing, quality, simhash, token_files, url_filter, warc

SPACE = "[\\x20\\x09-\\x0D]+"


def low(text: str) -> str:
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


# Mixing.


def test_mixing_reaches_targets(docs, rows):
    got = mixing.mix_copies(docs.select("doc_id", "source", "text", "size")).collect()
    assert len(got) == len(rows)
    by = defaultdict(list)
    for r in got:
        by[r.source].append(r)
    for source, own in by.items():
        total, largest = sum(r.size for r in own), max(r.size for r in own)
        assert {r.source_size for r in own} == {total} and own[0].target <= 3 * total
        assert abs(sum(r.copies * r.size for r in own) - own[0].target) <= 2 * largest + 1
        assert all(0 <= r.copies <= 3 for r in own)
    sizes = Counter({(i, s): len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t, _, s, _ in rows})
    assert all(sizes[r.doc_id, r.source] == r.size for r in got)
    again = mixing.mix_copies(docs.repartition(5)).collect()
    assert Counter(map(tuple, got)) == Counter(map(tuple, again))


def test_targets_are_filled_by_weight(spark):
    sizes = {"a": 10, "b": 1000, "c": 1000, "d": 0, None: 90}
    got = {r.source: r.target for r in mixing.source_targets(spark.createDataFrame(list(sizes.items()), "source string, source_size long")).collect()}
    weights, left, want = dict(zip(["a", "b", "c", "d", None], [5, 2, 1, 5, 2])), float(sum(sizes.values())), {}
    free = dict(weights)
    while True:
        over = [s for s in free if free[s] * left / sum(free.values()) > 3 * sizes[s]]
        if not over:
            break
        for s in over:
            want[s] = 3.0 * sizes[s]
        left -= sum(3 * sizes[s] for s in over)
        for s in over:
            del free[s]
    want |= {s: w * left / sum(free.values()) for s, w in free.items()}
    assert got == pytest.approx(want) and sum(got.values()) == pytest.approx(sum(sizes.values()))


def test_mix_emits_copies(docs):
    taken = {r.doc_id: r.copies for r in mixing.mix_copies(docs.where("doc_id > 7")).collect() if r.size}
    out = Counter(r.doc_id for r in mixing.mix(docs.where("doc_id > 7")).select("doc_id").collect())
    assert out == Counter({k: v for k, v in taken.items() if v})
    assert mixing.mix(docs).columns == docs.columns
    total = sum(r.copies for r in mixing.mix_copies(docs).collect() if r.size)
    assert mixing.mix(docs).count() == total


# Token files.


def test_token_files_round_trip(docs, rows, tmp_path):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    folder, plain = f"file://{tmp_path}/t", Tokenizer.from_file(path)
    got = sorted(map(tuple, token_files.token_files(docs, path, 1, folder).collect()), key=lambda r: r[1])
    ids = {t: [*plain.encode(t or "", add_special_tokens=False).ids, 1] for _, t, *_ in rows}
    at = 0
    for (doc_id, start, n, crc), (want_id, text) in zip(got, sorted([(i, t) for i, t, *_ in rows], key=lambda x: (x[0] is not None, x[0] or 0, x[1] or "")), strict=True):
        assert (doc_id, start, n, crc) == (want_id, at, len(ids[text]), zlib.crc32(np.array(ids[text], "<u4").tobytes()))
        at += n


@settings(max_examples=40, deadline=None)
@given(some.text(some.characters(exclude_categories=["Cs"]), max_size=60))
def test_remembered_words_change_no_ids(text):
    import public_tokenizers

    own = token_files.tokenizer(public_tokenizers.path("word_bpe_49k.json"))
    assert isinstance(own, token_files.WordTokenizer)
    for t in (text, text.upper() + " The, the. THE", "<|ENDOFTEXT|> <|endoftext|> " + text):
        assert own.encode(t) == np.array(own.tokenizer.encode(t, add_special_tokens=False).ids, "<u4").tobytes()


def test_spellings_of_a_word_are_encoded_once():
    """Case, accents and marks behind a word need no run of the whole tokenizer, and give its ids."""
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    own, plain = token_files.WordTokenizer(path), Tokenizer.from_file(path)
    letters = [chr(c) + d + m for c in range(0x21, 0x250) for d in ("A", "é", "İ", "\u0301", "'") for m in ("", "!?", "'s", "''", "<|")]
    for text in ("Étionçment, ÉTIONÇMENT$$$ étionçment.", " ".join(letters)):
        assert own.encode(text) == np.array(plain.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    class Counted:
        def __init__(self):
            self.calls = 0

        def encode(self, *a, **k):
            self.calls += 1
            return plain.encode(*a, **k)

    own = token_files.WordTokenizer(path)
    own.tokenizer = own.known.tokenizer = counted = Counted()
    own.encode("Étionçment, ÉTIONÇMENT$$$ étionçment. Größe GRÖßE, plain Plain. PLAIN***")
    assert counted.calls == 4  # the marks


def test_other_tokenizers_get_whole_texts(docs, rows, tmp_path):
    """A byte-level tokenizer keeps case and spaces: its ids are not those of pieces."""
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    assert not token_files.splits_at_spaces(path)
    plain = Tokenizer.from_file(path)
    got = token_files.token_files(docs.withColumn("doc_id", F.col("doc_id").cast("string")), path, 7, f"file://{tmp_path}/t").collect()
    want = Counter()
    for doc_id, text, *_ in rows:
        ids = [*plain.encode(text or "", add_special_tokens=False).ids, 7]
        want[None if doc_id is None else str(doc_id), len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())] += 1
    assert Counter((r.doc_id, r.n_tokens, r.ids_crc32) for r in got) == want


def test_changed_tokenizer_files_lose_the_shortcut(tmp_path):
    import json

    import public_tokenizers

    with open(public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8") as f:
        spec = json.load(f)
    spec["model"] = {"type": "BPE", "vocab": {"a</w>": 0}, "merges": [], "dropout": None, "unk_token": None, "continuing_subword_prefix": None, "end_of_word_suffix": "</w>", "fuse_unk": False, "byte_fallback": False}
    spec["added_tokens"] = []

    def splits(**changes):
        (tmp_path / "t.json").write_text(json.dumps({**spec, **changes}))
        return token_files.splits_at_spaces(str(tmp_path / "t.json"))

    split, bytes_ = spec["pre_tokenizer"]["pretokenizers"]
    assert splits()
    assert not splits(normalizer=None) and not splits(normalizer={"type": "NFC"}) and not splits(pre_tokenizer=None)
    assert not splits(pre_tokenizer={"type": "Sequence", "pretokenizers": [{**split, "pattern": {"Regex": " ?[a-z]+|[^a-z]"}}, bytes_]})
    assert not splits(pre_tokenizer={"type": "Sequence", "pretokenizers": [{**split, "pattern": {"Regex": "[^\\s]+"}}, bytes_]})


def test_shards_end_after_so_many_documents(spark, tmp_path, monkeypatch):
    import public_tokenizers

    made = spark.createDataFrame([(k, f"w{k}") for k in range(23)], "doc_id long, text string").coalesce(1)
    got = token_files.write_tokens(made, public_tokenizers.path("word_bpe_49k.json"), 1, f"file://{tmp_path}/t", shard_docs=3).orderBy("shard").collect()
    assert len(got) >= 8 and max(r.n_docs for r in got) == 3 and sum(r.n_docs for r in got) == 23
    manifest = token_files.read_manifest(spark, f"file://{tmp_path}/t")
    read = sorted(map(tuple, token_files.read_documents(manifest).select("doc_id", "start", "n_tokens").collect()))
    assert [r[0] for r in read] == list(range(23)) and all(a[1] + a[2] == b[1] for a, b in zip(read, read[1:]))


def test_blocks_of_a_shard(tmp_path):
    random, docs = np.random.default_rng(0), []
    out = token_files.ShardWriter(f"file://{tmp_path}", "s")
    for k, n in enumerate([0, 1, 70_000, 65_536, 3, 200_000]):
        docs.append((None if k == 1 else k, random.integers(0, 2**32, n, dtype=np.uint32).astype("<u4").tobytes()))
        out.add(*docs[-1])
    out.close()
    read = token_files.ShardReader(f"file://{tmp_path}/s")
    assert [(d, b"".join(p)) for d, p, _ in read.documents()] == docs
    assert len(read.chunk_index) == -(-335_540 // token_files.BLOCK)
    (tmp_path / "bad").write_bytes((tmp_path / "s").read_bytes()[:-1] + b"?")
    with pytest.raises(ValueError):
        token_files.ShardReader(f"file://{tmp_path}/bad")


# Languages.


def test_languages_are_told_apart(spark, docs):
    r = {"aa": "ka lo mi ren tu", "bb": "zor pex qui wam yd", "cc": "été où ça né"}
    import random

    made = [(k, " ".join(random.Random(k).choices(r[x].split(), k=30)), x, None, None) for k in range(240) for x in [list(r)[k % 3]]]
    model = language.train(spark.createDataFrame(made, SCHEMA).where(~language.held_out(F.col("doc_id"))))
    got = {x.doc_id: x for x in language.predict(spark.createDataFrame(made, SCHEMA), model).collect()}
    assert all(got[k].lang_pred == x and 0.5 < got[k].score <= 1 for k, _, x, *_ in made)
    other = {x.doc_id: x for x in language.predict(docs.where("doc_id in (30, 31, 32, 33)"), model).collect()}
    assert [other[k].lang_pred for k in (30, 31, 32)] == ["und"] * 3 and other[30].score == 0 and other[33].rejected
    odd = spark.createDataFrame([(1, "12 !? 🙂", None, None, None), (2, "𐐀𐐁", None, None, None)], SCHEMA)
    assert {x.doc_id: x.lang_pred == "und" for x in language.predict(odd, model).collect()} == {1: True, 2: False}


def test_kneser_ney_by_hand():
    text = "abab acab abba"
    counts = Counter()
    seq = language.units(text)
    keys, n = np.unique(np.concatenate(list(language.pieces(seq))), return_counts=True)
    table = language.fit(keys, n)
    padded = "   " + text
    grams4 = Counter(padded[k : k + 4] for k in range(len(text)))
    levels = {4: grams4}
    for k in (3, 2, 1):
        levels[k] = Counter(g[1:] for g in levels[k + 1])

    def p(gram: str) -> float:
        if not gram:
            return 1 / language.SYMBOLS
        c, own = levels[len(gram)], {g: v for g, v in levels[len(gram)].items() if g[:-1] == gram[:-1]}
        once, twice = sum(v == 1 for v in c.values()), sum(v == 2 for v in c.values())
        d = once / (once + 2 * twice) if once and twice else 0.5
        if not own:
            return p(gram[1:])
        return max(own.get(gram, 0) - d, 0) / sum(own.values()) + d * len(own) / sum(own.values()) * p(gram[1:])

    for gram in [*grams4, "zzzz", "abaz", "zaba", " ab "]:
        if len(gram) == 4:
            key = language.grams(language.np.frombuffer(gram.encode("utf-16-le"), np.uint16))[-1:]
            assert language.log_probability(table, key)[0] == pytest.approx(np.log(p(gram)), rel=1e-4)
    del counts


def test_long_texts_are_scored_in_parts():
    seq = np.tile(np.frombuffer("abcde ".encode("utf-16-le"), np.uint16), 400_000)
    whole = language.grams(seq)
    assert np.array_equal(np.concatenate(list(language.pieces(seq))), whole)


def test_nothing_to_learn(empty, docs):
    got = language.identify(docs.select("doc_id", "text", F.lit(None).cast("string").alias("lang"))).collect()
    assert {r.lang_pred for r in got} == {"und"} and language.identify(empty).count() == 0


# Media.


def test_media_round_trip(docs, rows):
    texts = {i: t for i, t, *_ in rows}
    got = media.media_features(docs).collect()
    assert len(got) == len(rows)
    for r in got:
        data = (texts[r.doc_id] or "").encode()
        padded = data + bytes(-len(data) % 64 if data else 64)
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(data), len(padded), hashlib.sha256(padded).hexdigest(), zlib.crc32(padded[-64:]))
    same = {r.doc_id: (r.media_sha256, r.feature, r.media_bytes) for r in got}
    assert same[34] == same[35] == same[5] and same[30] == same[31] and same[34] != same[36]


def plain_unfilter(kinds, rows):
    """The format's definition, sample by sample."""
    out = np.zeros(rows.shape, int)
    for y in range(rows.shape[0]):
        for x in range(rows.shape[1]):
            a, b, c = (int(out[y - j, x - i]) if y >= j and x >= i else 0 for i, j in ((1, 0), (0, 1), (1, 1)))
            p = a + b - c
            nearest = min((abs(p - v), k) for k, v in enumerate((a, b, c)))[1]
            out[y, x] = (int(rows[y, x]) + (0, a, b, (a + b) // 2, (a, b, c)[nearest])[kinds[y]]) % 256
    return out


@pytest.mark.parametrize("kinds", [[0] * 9, [1] * 9, [2] * 9, [3] * 9, [4] * 9, [2, 2, 0, 2, 1, 2, 2, 1, 2], [4, 2, 2, 3, 4, 0, 2, 3, 2], [3, 4, 1, 2, 4, 2, 2, 2, 3]])
def test_png_filters(kinds):
    r, kinds = np.random.default_rng(sum(kinds)), np.array(kinds, np.uint8)
    rows = r.integers(0, 256, (9, 64)).astype(np.uint8)
    samples = media.unfilter(kinds, rows)
    assert np.array_equal(samples, plain_unfilter(kinds, rows))
    assert all(np.array_equal(media.residual(samples, k)[y], rows[y]) for y, k in enumerate(kinds.tolist()))
    data = media.encode_png(samples, tuple(dict.fromkeys(kinds.tolist())))
    assert np.array_equal(media.decode_png(data), samples)
    for at in (20, len(data) // 2, len(data) - 6):
        with pytest.raises((ValueError, zlib.error)):
            media.decode_png(data[:at] + bytes([data[at] ^ 1]) + data[at + 1 :])


def test_rows_have_the_filter_of_the_least_sum(monkeypatch):
    monkeypatch.setattr(media, "TOGETHER", 4)
    text = prose(3, 400).encode()
    samples = np.frombuffer(media.payload(text), np.uint8).reshape(-1, 64)
    for filters in (media.RUNS, range(5)):
        data = media.encode_png(samples, tuple(filters))
        rows = np.frombuffer(zlib.decompress(data[41 : 41 + int.from_bytes(data[33:37], "big")]), np.uint8).reshape(-1, 65)
        sums = [[int(np.abs(media.residual(samples, f)[y].view(np.int8).astype(int)).sum()) for f in filters] for y in range(len(samples))]
        assert rows[:, 0].tolist() == [int(np.argmin(s)) for s in sums] and len(set(rows[:, 0].tolist())) > 1
        assert media.decode_png(data).tobytes() == media.payload(text)


def test_features_follow_low_frequencies():
    r = np.random.default_rng(0)
    base, other = (np.kron(r.integers(20, 230, (8, 8)), np.ones((16, 8))).astype(np.uint8) for _ in range(2))
    noisy = (base + r.integers(0, 4, base.shape)).astype(np.uint8)
    apart = lambda a, b: bin(int(media.feature(a), 16) ^ int(media.feature(b), 16)).count("1")
    assert apart(base, noisy) <= 6 and apart(base, other) > 14
    assert media.feature(np.zeros((1, 64), np.uint8)) == "0" * 16


# URLs.

URLS = [
    (1, "http://a.ORG/x"), (2, "https://www.Example.org/es/1?q"), (3, "https://example.org/en/12"), (4, "https://xexample.org/es/1"), (5, "http://a.com/fr/1#t"),
    (6, "http://a.com/de/"), (7, "http://a.com/de"), (8, None), (9, "no scheme"), (10, "http://org"), (11, ""), (12, "x://cheap-viagra-shop.biz/order/9://"),
    (13, "http://b.example.net/q?u=http://a.org/"), (14, "http://a.org"), (15, "HTTP://u.ORG/\nline#x"), (16, "a//b://h/p"),
]


def test_url_rules(spark):
    got = {r.page_id: r for r in url_filter.judge(spark.createDataFrame(URLS, "page_id long, url string")).collect()}
    for k, url in URLS:
        host = path = ""
        if url and "://" in url:
            rest = url.split("://", 1)[1]
            host = low(re.match("[^/?#]*", rest)[0])
            path = re.match("[^?#]*", rest[len(host) :])[0]
        fits = []
        for verdict, rule in url_filter.RULES:
            h, slash, begin = rule.partition("/")
            if (host == h or host.endswith("." + h)) and path.startswith(slash + begin):
                fits.append((len(rule), rule, verdict))
        best = max(fits, default=(0, None, None))
        assert (got[k].host, got[k].path, got[k].rule) == (host, path, best[1]), url
        assert got[k].verdict == (best[2] or ("block" if got[k].score >= 0.5 else "allow"))
    assert got[12].verdict == "block" and got[13].verdict == "allow" and got[8].verdict in ("allow", "block")


def test_url_weights_by_brute_force(spark):
    table = url_filter.labelled(spark)
    rows = table.select("label", url_filter.features(url_filter.host_of(F.col("url")), url_filter.path_of(F.col("url"))).alias("f")).collect()
    x, y = np.zeros((len(rows), url_filter.BUCKETS)), np.array([r.label for r in rows], float)
    for k, r in enumerate(rows):
        for g in r.f:
            x[k, g.id] += g.x
    w, b = np.zeros(url_filter.BUCKETS), 0.0
    for _ in range(20):
        e = 1 / (1 + np.exp(-(x @ w + b))) - y
        w, b = w * (1 - url_filter.SHRINK) - url_filter.RATE * x.T @ e / len(y), b - url_filter.RATE / 4 * e.sum() / len(y)
    got = np.array(url_filter.trained(table, steps=20).first().w)
    assert np.allclose(got, [*w, b])


def test_url_training_is_bounded(spark):
    with pytest.raises(ValueError):
        url_filter.trained(spark.range(url_filter.MOST_LABELLED + 1).selectExpr("'x' AS url", "1 AS label"))
    assert url_filter.judge(spark.createDataFrame([], "page_id long, url string")).count() == 0


# Decontamination.


def brute_hits(text, items):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low(text or ""))
    hit, named = set(), set()
    for name, item in items:
        own = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low(item or ""))
        m = min(13, len(own))
        windows = {tuple(own[k : k + m]) for k in range(len(own) - m + 1)} if m else set()
        for k in range(len(words) - m + 1 if m else 0):
            if tuple(words[k : k + m]) in windows:
                hit |= set(range(k, k + m))
                named |= set() if name is None else {str(name)}
    return words, hit, named


ITEMS = [(k, prose(200 + k, 30)) for k in range(6)] + [(10, "short item"), (11, "one"), (12, ""), (13, None), (2, prose(202, 30)), (14, prose(200, 13)), (15, "ABC abc ABC abc"), (16, "abc"), (None, prose(207, 20))]


@pytest.mark.parametrize("block_words", [10**6, 40])
def test_decontamination(spark, docs, block_words):
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    dirty = [(900, prose(900, 50) + " " + prose(201, 30)[10:] + ". tail"), (901, "a SHORT, item!"), (902, prose(203, 12)), (903, prose(203, 14) + " x " + prose(204, 30)), (904, "abc ABC abc abc abc one"), (905, prose(905, 600) + " " + prose(205, 15)), (906, prose(207, 20))]
    both = docs.select("doc_id", "text").union(spark.createDataFrame(dirty, "doc_id long, text string"))
    texts = both.collect()
    found = decontaminate.find(both, items, ["doc_id"], block_words=block_words)
    got = {r.row.doc_id: r for r in found.collect() if r.row.doc_id is not None}
    for doc_id, text in texts:
        if doc_id is None:
            continue
        words, hit, named = brute_hits(text, ITEMS)
        r = got[doc_id]
        assert r.n_words == len(words) and sorted(named) == r["items"]
        assert {k for s in r.spans for k in range(s.a, s.b)} == hit
    kept = {r.doc_id: r.text for r in decontaminate.clean(both, items).collect()}
    assert not {900, 901, 903, 906} & set(kept) and 902 in kept and {k for k in range(30)} <= set(kept)
    assert kept[905].startswith(prose(905, 600)) and not brute_hits(kept[905], ITEMS)[1]
    assert all(kept[k] == t for k, t in texts if k in kept and not brute_hits(t, ITEMS)[1])


def test_decontamination_without_items(spark, docs, empty):
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.report(docs, none).where("n_hit > 0 or contaminated").count() == 0
    assert decontaminate.report(empty, none).count() == 0
    out = decontaminate.clean(docs, none)
    assert out.columns == docs.columns and out.count() == docs.count()


@settings(max_examples=60, deadline=None)
@given(some.lists(some.lists(some.sampled_from("abc"), max_size=9), max_size=5), some.lists(some.sampled_from("abcd"), max_size=30))
def test_automaton(items, words):
    named = [(str(k), [w.encode() for w in ws]) for k, ws in enumerate(items)]
    spans, found = decontaminate.Automaton(named, window=3).search([w.encode() for w in words])
    hit, names = set(), set()
    for k, ws in enumerate(items):
        m = min(3, len(ws))
        for i in range(len(ws) - m + 1 if m else 0):
            for j in range(len(words) - m + 1):
                if words[j : j + m] == ws[i : i + m]:
                    hit |= set(range(j, j + m))
                    names.add(str(k))
    assert {k for a, b in spans for k in range(a, b)} == hit and found == names


# WARC.


def test_warc(spark, tmp_path):
    big = "<p>" + "é" * 600
    pages = [(k, f"http://www.Ex{k % 3}.org/p?q={k}#f", big if k % 4 == 0 else f"<p>{k}</p>" if k % 2 else prose(k, 400)) for k in range(40)]
    pages += [(40, None, None), (41, "", ""), (42, "http://ex0.org/p", "x" * 999), (43, "http://ex0.org/p", "x" * 999), (None, "http://n.org/", big), (36, pages[36][1], big), (44, "http://l.org/", prose(3, 40_000))]
    made = spark.createDataFrame(pages, "page_id long, url string, html string").withColumn("digest", F.lit("clash")).repartition(3)
    got = Counter(map(tuple, warc.archive(made, folder=f"file://{tmp_path}/w").collect()))
    groups = defaultdict(list)
    for k, _, html in pages:
        groups[(html or "").encode()].append(-1 if k is None else k)
    want = Counter()
    for k, _, html in pages:
        data = (html or "").encode()
        top = max(groups[data])
        revisit = len(data) >= 1000 and (-1 if k is None else k) != top
        want[k, len(data), hashlib.sha1(data).hexdigest(), "revisit" if revisit else "response", top if revisit else None] += 1
    assert got == want
    history = spark.read.parquet(f"file://{tmp_path}/w/_history").collect()
    parts = sorted(p for p in (tmp_path / "w/_history").iterdir() if p.suffix == ".parquet")
    import pyarrow.parquet as pq

    in_order = [row for p in parts for row in zip(*(pq.read_table(p)[c].to_pylist() for c in ("url_key", "captured")))]
    assert in_order == sorted(in_order, key=lambda r: (r[0].encode(), r[1])) and len(history) == len(pages)
    assert warc.archive(made.limit(0)).count() == 0


def test_warc_takes_any_page_id_in_any_zone(spark, tmp_path):
    ids = [2**62, -(2**62), 2**60, -1, 0, 5, None, 20_000_000, 2**63 - 1]
    pages = [(k, "http://a.org/", f"<p>{k}") for k in ids] + [(k, "http://b.org/", "same" * 300) for k in ids]
    made, zone = spark.createDataFrame(pages, "page_id long, url string, html string"), spark.conf.get("spark.sql.session.timeZone")
    want = Counter((k, "response", None) for k in ids) + Counter((k, "response" if k == max(x for x in ids if x is not None) else "revisit", None if k == 2**63 - 1 else 2**63 - 1) for k in ids)
    dates = {}
    for z in ("UTC", "America/New_York"):
        spark.conf.set("spark.sql.session.timeZone", z)
        try:
            got = warc.archive(made, folder=f"file://{tmp_path}/{z[:3]}").collect()
            dates[z] = Counter((r.page_id, r.captured) for r in spark.read.parquet(f"file://{tmp_path}/{z[:3]}/_history").collect())
        finally:
            spark.conf.set("spark.sql.session.timeZone", zone)
        assert Counter((r.page_id, r.record_type, r.refers_to) for r in got) == want
    assert dates["UTC"] == dates["America/New_York"]
    at = dict(dates["UTC"].keys())
    assert at[0] == "2024-01-01T00:00:00Z" and at[5] == "2024-01-01T00:00:05Z" and at[20_000_000] == "2024-08-19T11:33:20Z" and at[-1] == "2024-12-30T23:59:59Z"


def test_pages_are_not_dealt_by_digest(spark):
    """Very many equal pages, empty and long: no exchange has the html by its digest."""
    pages = spark.range(3000).selectExpr("id AS page_id", "'http://a.org/' || id AS url", "CASE WHEN id % 3 = 0 THEN '' ELSE repeat('error page ', 200) END AS html")
    plan = warc.planned(pages)
    dealt = [x for x in plan._jdf.queryExecution().executedPlan().toString().splitlines() if "hashpartitioning(" in x]
    assert all("page_id" in x for x in dealt)
    got = Counter((r.revisit, r.refers_to) for r in plan.select("revisit", "refers_to").collect())
    assert got == {(False, None): 1001, (True, 2999): 1999}


@pytest.mark.parametrize("most", [7, 1000])
def test_merged_history_is_one_order(spark, tmp_path, monkeypatch, most):
    import pyarrow.parquet as pq

    monkeypatch.setattr(warc, "RANGE", most)
    made = spark.createDataFrame([(k if k % 5 else None, f"http://h{k % 3}.org/{k % 2}", f"{k}") for k in range(60)], "page_id long, url string, html string").repartition(4)
    runs = warc.write_runs(warc.planned(made), f"file://{tmp_path}/w", file_bytes=1500)
    assert runs.select("run").distinct().count() > 5
    warc.merge_runs(runs, f"file://{tmp_path}/w")
    parts = sorted(p for p in (tmp_path / "w/_history").iterdir() if p.suffix == ".parquet")
    rows = [warc.order(r) for p in parts for r in zip(*(c.to_pylist() for c in pq.read_table(p).columns))]
    assert rows == sorted(rows) and len(rows) == 60


def test_warc_files_are_bounded(spark, tmp_path):
    plan = warc.planned(spark.range(50).selectExpr("id AS page_id", "'http://a.org/' || id AS url", "repeat(sha2(string(id), 256), 30) AS html")).coalesce(1)
    assert warc.write_runs(plan, f"file://{tmp_path}/w", file_bytes=5_000).select("run").distinct().count() > 2


def test_damaged_record():
    data = warc.record(1, "http://a.org/", "2024-01-01T00:00:00Z", b"x" * 50, None, False)
    assert warc.parse(data)["payload_bytes"] == 50
    with pytest.raises(ValueError):
        warc.parse(data.replace(b"xxx", b"xyx", 1))
    assert base64.b32encode(hashlib.sha1(b"x" * 50).digest()) in data


@given(some.lists(some.lists(some.integers(0, 50)), max_size=9))
def test_loser_tree(runs):
    assert [x for (x,) in warc.LoserTree([[(x,) for x in sorted(r)] for r in runs])] == sorted(x for r in runs for x in r)


def test_url_keys():
    assert warc.url_key("https://www.Example.ORG/A?b=C#d") == "org,example)/a?b=c" and warc.url_key(None) == "" and warc.url_key("http://a.b") == "b,a)/"


# Lines.


@pytest.mark.parametrize("options", [{}, {"set_up_to": 0}, {"most_bits": 1 << 10}, {"shared_by": 2, "shortest": 8}])
def test_line_dedup(docs, rows, options):
    by, shortest = options.get("shared_by", 10), options.get("shortest", 1)
    key = lambda line: low(line.strip(" \t\n\x0b\x0c\r"))
    seen = Counter(k for _, t, *_ in rows for k in {key(x) for x in (t or "").split("\n")} if len(k) >= shortest)
    got = Counter(map(tuple, line_dedup.report(docs, **options).collect()))
    want = Counter()
    for i, t, *_ in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if not (len(key(x)) >= shortest and seen[key(x)] >= by)]
        want[i, len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()] += 1
    assert got == want


@pytest.mark.parametrize("options", [{}, {"shared_by": 2}, {"shared_by": 3, "shortest": 6}])
def test_dealt_filters(docs, rows, monkeypatch, options):
    """Filters dealt by segment, with few lines in each: the same lines go."""
    monkeypatch.setattr(line_dedup, "SEGMENT_LINES", 20)
    monkeypatch.setattr(line_dedup, "GATHERED", 25)
    whole, dealt = (Counter(map(tuple, line_dedup.report(docs, most_bits=m, **options).collect())) for m in (1 << 28, 0))
    assert whole == dealt and sum(r[2] for r in whole) > 0
    found = line_dedup.often_seen(docs, 100, 10, 1).collect()
    key = lambda line: low(line.strip(" \t\n\x0b\x0c\r"))
    seen = Counter(k for _, t, *_ in rows for k in {key(x) for x in (t or "").split("\n")} if k)
    assert {xxhash.xxh3_64_intdigest(k.encode()) for k, n in seen.items() if n >= 10} <= {r.hash % 2**64 for r in found} and len(found) < len(seen) / 4


def test_line_dedup_of_nothing(empty):
    assert line_dedup.report(empty).count() == 0
    with pytest.raises(ValueError):
        line_dedup.report(empty, shared_by=1)


def test_twice_seen_filter_has_no_misses():
    a, b = line_dedup.SeenTwice(2), line_dedup.SeenTwice(2)
    x = np.random.default_rng(1).integers(0, 2**63, 4000, dtype=np.uint64)
    a.add(x[:2000])
    b.add(x[1000:])
    merged = line_dedup.Filter(2)
    merged.bitmap[:] = a.twice.bitmap | b.twice.bitmap | (a.once.bitmap & b.once.bitmap)
    there = merged.has(merged.places(x))
    assert there[1000:2000].all() and there.mean() < 0.4


# Quality.


def test_training_rows_stay_arrays():
    """The driver cuts the gathered features from the columns, whatever their chunks."""
    import pyarrow as pa

    kind = pa.schema([("at", pa.list_(pa.int32())), ("x", pa.list_(pa.float32()))])
    parts = [pa.table({"at": a, "x": [[v / 2 for v in r] for r in a]}, kind) for a in ([[9], [1, 2]], [[3]], [[], [4, 5, 6]])]
    for rows in (pa.concat_tables([parts[0].slice(1), *parts[1:]]), parts[0].slice(0, 0)):
        at, x, ends = quality._flat(rows)
        assert [at[a:b].tolist() for a, b in zip(ends, ends[1:])] == rows["at"].to_pylist()
        assert [x[a:b].tolist() for a, b in zip(ends, ends[1:])] == rows["x"].to_pylist()


def test_quality_learns_structure(spark, docs):
    junk = lambda k: " ".join(w + "$$$" for w in prose(k, 40).split())
    made = [(k, junk(k) if k % 4 == 0 else prose(k, 40), None, None, None) for k in range(600)]
    frame, labels = spark.createDataFrame(made, SCHEMA), spark.createDataFrame([(k, int(k % 4 != 0), 0) for k in range(600)] + [(None, 1, 0), (5, None, 0)], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in quality.classify(frame, labels).collect()}
    assert all(r.held_out == (zlib.crc32(str(k).encode()) % 3 == 1) for k, r in got.items())
    assert sum(got[k].predicted == int(k % 4 != 0) for k in got if got[k].held_out) / sum(r.held_out for r in got.values()) > 0.97
    odd = quality.classify(docs, labels)
    assert odd.count() == docs.count() and odd.where("score is null or score < 0 or score > 1 or predicted <> int(score >= 0.5)").count() == 0
    again = {r.doc_id: r.score for r in quality.classify(frame.repartition(3), labels).collect()}
    assert all(again[k] == pytest.approx(got[k].score, abs=1e-9) for k in got)
    kept = quality.good_only(docs, labels)
    assert kept.columns == docs.columns


def test_quality_sample_is_the_same_for_any_partitions(spark):
    """Repeated doc_ids do not swell the sample, and neither their order nor the partitions change the model."""
    made = [(k % 50, prose(k, 30 + k % 7)) for k in range(3000)]
    labels = spark.createDataFrame([(k, k % 2, 0) for k in range(50)] * 3, "doc_id long, quality int, toxic int")
    frame, models, sizes = spark.createDataFrame(made, "doc_id long, text string"), [], []
    whole, fitted = quality.fit, lambda rows, y: sizes.append(len(rows)) or whole(rows, y)
    for part in (frame.repartition(7), frame.orderBy(F.desc("text")).coalesce(2)):
        with pytest.MonkeyPatch.context() as m:
            m.setattr(quality, "fit", fitted)
            models.append(quality.train(part, labels, sample=20))
    assert sizes == [20, 20] and models[0]["bias"] == models[1]["bias"]
    assert np.array_equal(models[0]["w"], models[1]["w"]) and np.array_equal(models[0]["v"], models[1]["v"])


def test_quality_without_labels(docs, spark, empty):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert {round(r.score, 6) for r in quality.classify(docs, none).collect()} == {0.5}
    assert quality.classify(empty, none).count() == 0


def test_sum_of_squares_identity():
    r = np.random.default_rng(0)
    model = {"bias": 0.3, "w": r.normal(size=quality.DIMENSIONS), "v": r.normal(size=(quality.DIMENSIONS, quality.RANK))}
    at, x = np.array([3, 50, 1030, 1100]), np.array([0.5, 0.2, 1.0, 1.0])
    pairs = sum(model["v"][at[i]] @ model["v"][at[j]] * x[i] * x[j] for i in range(4) for j in range(i))
    assert quality.probability(model, at, x) == pytest.approx(1 / (1 + np.exp(-np.clip(0.3 + model["w"][at] @ x + pairs, -30, 30))))


# SimHash.


def brute_fingerprint(text) -> int:
    words = [w for w in re.split(SPACE, low(text or "")) if w]
    if not words:
        return 0
    shingles = [" ".join(words[k : k + 3]) for k in range(len(words) - 2)] or [" ".join(words)]
    values = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << k for k in range(64) if 2 * sum(v >> k & 1 for v in values) > len(values))


def brute_components(fps: dict) -> dict:
    up = {k: k for k in fps}

    def root(k):
        while up[k] != k:
            k = up[k]
        return k

    for a in fps:
        for b in fps:
            if a < b and bin(fps[a] ^ fps[b]).count("1") <= 2:
                x, y = sorted((root(a), root(b)))
                up[y] = x
    return {k: root(k) for k in fps}


def test_near_duplicates(docs, rows):
    fps = {i: brute_fingerprint(t) for i, t, *_ in rows if i is not None}
    want = brute_components(fps)
    got = simhash.near_duplicates(docs).select("doc_id", simhash.fingerprint_hex(F.col("fp")).alias("f"), "component_id").collect()
    assert len(got) == len(rows)
    assert all((int(r.f, 16), r.component_id) == (fps[r.doc_id], want[r.doc_id]) for r in got if r.doc_id is not None)
    kept = simhash.one_of_each(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect() if r.doc_id is not None) == sorted(set(want.values()))


def test_rows_without_ids_are_told_apart(spark):
    made = [(None, prose(1, 50)), (None, prose(1, 50)), (None, prose(2, 50)), (None, prose(3, 50)), (3, prose(3, 50)), (4, prose(4, 50)), (4, prose(4, 50))]
    out = simhash.one_of_each(spark.createDataFrame(made, "doc_id long, text string")).collect()
    assert sorted(map(tuple, out), key=str) == sorted({(None, prose(1, 50)), (None, prose(2, 50)), (3, prose(3, 50)), (4, prose(4, 50))}, key=str)


@pytest.mark.parametrize("pairs_up_to", [128, 2])
def test_links_lose_nothing(spark, monkeypatch, pairs_up_to):
    monkeypatch.setattr(simhash, "PAIRS_UP_TO", pairs_up_to)
    r, fps = np.random.default_rng(3), set()
    for _ in range(12):
        centre = int(r.integers(0, 2**63))
        for _ in range(25):
            x = centre
            for bit in r.choice(64, int(r.integers(0, 5)), replace=False):
                x ^= 1 << int(bit)
            fps.add(x - 2**64 if x >= 2**63 else x)
    edges = simhash.links(spark.createDataFrame([(x,) for x in fps], "fp long"))
    got = {x.node: x.root for x in simhash.components(edges).collect()}
    want = brute_components({x: x & (2**64 - 1) for x in fps})
    groups = lambda m: {frozenset(k for k in fps if m.get(k, k) == v) for v in {m.get(k, k) for k in fps}}
    assert groups(got) == groups(want)


def test_long_chain_is_one_component(spark):
    chain = spark.range(1, 400).selectExpr("id AS u", "id - 1 AS v")
    got = {r.node: r.root for r in simhash.components(chain).collect()}
    assert len(got) == 400 and set(got.values()) == {0}
    assert simhash.components(chain.limit(0)).count() == 0


def test_golay_code_is_perfect():
    check, errors = simhash.golay_tables()
    assert (errors >= 0).all() and len(set(errors.tolist())) == 2048
    words = np.arange(1 << 12) << 11 | check
    assert (simhash.nearest_codeword(words ^ 0b1000010000100) == np.arange(1 << 12)).all()


def test_near_duplicates_of_nothing(empty):
    assert simhash.near_duplicates(empty).count() == 0
    assert simhash.one_of_each(empty).columns == empty.columns


def test_items_that_repeat_are_one(spark):
    """However often an item's row is there, a block holds it once."""
    items = spark.range(500).select(F.lit(7).alias("item_id"), F.lit("one two three four").alias("text"))
    blocks = list(decontaminate.item_blocks(items.union(spark.createDataFrame([(8, "five six")], "item_id int, text string")), most=10))
    assert sorted(x for b in blocks for x in b) == [("7", b"one two three four"), ("8", b"five six")]
