"""Token records, merge replay and decontamination against brute force."""

import hashlib
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest

from tests_llm_helpers import brute_contamination, tiktoken_encoding
from tidemark.llm import bpe, decontam, records, registry

TEXTS = ["", None, "Hello   world\n\nfoo\t bar's 123 ééé", "a" * 5000, "x\x1cy\x85z w 　q", "é ́e  <|endoftext|> ", "\n \n  \nWe'll see 'twas", "日本語 текст ١٢٣ ß", "aaaa abab aaaaaaa", "Word. WORD, É. é, İ; ΣΑΣ. don't. a.. .b <|ENDOFTEXT|> <|endoftext|>. ﬁn. x́. it's' dogs'.. x## שּׁ. a'll."]
SCHEMA = "doc_id long, text string, pid string"


def docs(spark, texts=TEXTS):
    rows = [(i, t, "clash") for i, t in enumerate(texts)] + [(None, "null id", None), (3, "again 3", None), (3, "again 3", None)]
    return spark.createDataFrame(rows, SCHEMA)


def test_records_match_whole_text_encoding(spark, tmp_path):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    manifest = records.write_token_records(docs(spark), str(tmp_path), public_tokenizers.path("word_bpe_49k.json"), 2)
    got = sorted((r.start, r.doc_id, np.frombuffer(r.ids, "<u4").tolist()) for r in records.read_token_records(spark, str(tmp_path)).collect())
    assert manifest["docs"] == len(got) == len(TEXTS) + 3
    start, last = 0, -1
    by_id = dict(enumerate(TEXTS))
    for s, doc_id, ids in got:
        assert s == start
        start += len(ids)
        assert (doc_id is None and last == -1) or doc_id >= last
        last = -1 if doc_id is None else doc_id
        wants = {None: ["null id"], 3: ["again 3", by_id[3]]}.get(doc_id, [by_id.get(doc_id)])
        assert ids in [[*tok.encode(w or "", add_special_tokens=False).ids, 2] for w in wants]
    assert start == manifest["ids"]
    shuffled = records.read_token_records(spark, str(tmp_path), seed=5).collect()
    assert sorted((r.start, r.doc_id, np.frombuffer(r.ids, "<u4").tolist()) for r in shuffled) == got


def test_records_refuse_damage():
    data = bytearray(records.frame(b"payload"))
    assert bytes(records.unframe(memoryview(data), 0)[0]) == b"payload"
    data[14] ^= 1
    with pytest.raises(ValueError):
        records.unframe(memoryview(data), 0)


def test_records_leave_other_files_alone(spark, tmp_path):
    (tmp_path / "mine.txt").write_text("keep")
    tokenizer = public_tokenizers.path("word_bpe_49k.json")
    first = records.write_token_records(docs(spark, ["a b"]), str(tmp_path), tokenizer, 2)
    second = records.write_token_records(docs(spark, ["c"]), str(tmp_path), tokenizer, 2)
    names = {p.name for p in tmp_path.iterdir() if not p.name.startswith(".")}
    assert names == {"mine.txt", "manifest.json"} | {f"{f['name']}.{k}" for m in (first, second) for f in m["files"] for k in ("rec", "idx")}
    assert records.read_token_records(spark, str(tmp_path)).count() == second["docs"]


def test_records_of_empty_table(spark, tmp_path):
    manifest = records.write_token_records(docs(spark).where("false"), str(tmp_path), public_tokenizers.path("word_bpe_49k.json"), 2)
    assert manifest["docs"] == 0 and records.read_token_records(spark, str(tmp_path)).count() == 0


def test_merge_replay_equals_tiktoken(spark, sf_dir):
    enc, path = tiktoken_encoding(), public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    codec = bpe.Codec(path, public_tokenizers.PATTERN)
    rng = np.random.default_rng(0)
    noise = ["".join(chr(c) for c in rng.choice([32, 97, 98, 99, 0xE9, 0x4E2D, 10, 39, 48], 60)) for _ in range(300)]
    real = [r.text for r in registry.table(spark, sf_dir, "documents").select("text").collect()]
    for t in [x for x in TEXTS if x] + noise + real:
        ids = codec.encode(t)
        assert ids == enc.encode_ordinary(t)
        assert codec.decode(ids) == t.encode()


def test_replay_with_ranks_that_fall():
    """Merges may make pairs of lower rank; each word still takes its lowest first."""
    rng = np.random.default_rng(1)
    for _ in range(200):
        ranks = {bytes([b]): b for b in range(256)}
        made = [b"a", b"b", b"c"]
        extra = set()
        while len(extra) < 30:
            extra.add(made[rng.integers(len(made))] + made[rng.integers(len(made))])
            made += [x for x in extra if len(x) < 5]
        for r, x in enumerate(rng.permutation(sorted(extra))):
            ranks[bytes(x)] = 256 + r
        tokens = [b""] * (256 + 30)
        for t, r in ranks.items():
            tokens[r] = t
        words = [bytes(rng.choice(list(b"abc"), rng.integers(0, 12))) for _ in range(20)]
        ids, ends = bpe.replay(words, ranks, tokens, {}, bpe.byte_pairs(ranks))
        for word, a, b in zip(words, [0, *ends], ends, strict=False):
            got = ids[a:b]
            parts = [bytes([b]) for b in word]
            while True:
                best = min(((ranks[parts[i] + parts[i + 1]], i) for i in range(len(parts) - 1) if parts[i] + parts[i + 1] in ranks), default=None)
                if best is None:
                    break
                i = best[1]
                parts[i : i + 2] = [parts[i] + parts[i + 1]]
            assert got == [ranks[p] for p in parts]


def test_bpe_columns(spark):
    path, enc = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), tiktoken_encoding()
    ids = bpe.encode_column(docs(spark), path, public_tokenizers.PATTERN)
    back = bpe.decode_column(ids, path, public_tokenizers.PATTERN)
    assert sorted(bytes(r.decoded) for r in back.collect()) == sorted((r.text or "").encode() for r in docs(spark).collect())
    for r in bpe.round_trip_digests(docs(spark, TEXTS).where("doc_id <> 3"), path, public_tokenizers.PATTERN).collect():
        want = enc.encode_ordinary(TEXTS[r.doc_id] or "")
        assert (r.n_tokens, r.ids_sha256) == (len(want), hashlib.sha256(",".join(map(str, want)).encode()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256((TEXTS[r.doc_id] or "").encode()).hexdigest()


def test_digests_see_wrong_word_ends(spark, monkeypatch):
    """Ids cut at wrong places between words decode to other bytes, and the digest tells."""
    path, text = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), "zyxwvu qwrtpsdf hjklmnbv"
    c = bpe.Codec(path, public_tokenizers.PATTERN)

    def finished(ids):
        of_word = ids
        (out,) = bpe.digests(c, [1], np.array([len(of_word)]), np.arange(len(of_word)), of_word)
        return out.column("decoded_sha256")[0].as_py()

    right = hashlib.sha256(text.encode()).hexdigest()
    assert finished(c.words([w.encode() for w in c.split(text)])) == right
    real = bpe.replay

    def shifted(*args):
        ids, ends = real(*args)
        return ids, [max(0, e - 1) for e in ends]

    monkeypatch.setattr(bpe, "replay", shifted)
    assert finished(c.words([w.encode() for w in c.split(text)])) != right


def test_packing():
    rng = np.random.default_rng(3)
    for x in (np.empty(0, np.int64), rng.integers(-(1 << 62), 1 << 62, 100), np.arange(70000)):
        assert bpe.unpacked(bpe.packed(x)).tolist() == x.tolist()
    for w in ([], [b""], [b"a", b"", "é\n".encode(), b"x" * 70000]):
        assert bpe.unpacked_words(bpe.packed_words(w)) == w


def test_one_vocabulary_for_many_slices(spark, monkeypatch, sf_dir):
    """Slices of a few texts, long texts and empty ones give what whole-text encoding gives."""
    path, enc = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), tiktoken_encoding()
    texts = [r.text for r in registry.table(spark, sf_dir, "documents").select("text").limit(60).collect()] + ["", None, "tail " * 90_000]
    for size, bucket in ((1, 100_000), (3000, 20_000), (16_000_000, 64_000_000)):
        monkeypatch.setattr(bpe, "SLICE", size)
        monkeypatch.setattr(bpe, "BUCKET", bucket)
        d = spark.createDataFrame([(i, t, 7) for i, t in enumerate(texts)], "doc_id long, text string, slice int").repartition(3)
        got = {r.doc_id: tuple(r)[1:] for r in bpe.round_trip_digests(d, path, public_tokenizers.PATTERN).collect()}
        for i, t in enumerate(texts):
            want = enc.encode_ordinary(t or "")
            assert got[i] == (len(want), hashlib.sha256(",".join(map(str, want)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest())
        assert len(got) == len(texts) and bpe.round_trip_digests(d.where("false"), path, public_tokenizers.PATTERN).count() == 0


def test_buckets_are_bounded_and_read_in_chunks(spark, monkeypatch, sf_dir):
    """Many slices that share a word: few rows a slice, lists without tokens, small chunks and memos, and the same ids."""
    path, enc = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), tiktoken_encoding()
    own = [r.text for r in registry.table(spark, sf_dir, "documents").select("text").limit(40).collect()]
    texts = [f"{t} zqxvzqxv zqxv{i % 7}" for i, t in enumerate(own * 5)] + ["the the", ""]
    c = bpe.Codec(path, public_tokenizers.PATTERN)
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    for name, value in (("SLICE", 1), ("BUCKET", 50), ("BUCKETS", 5)):
        monkeypatch.setattr(bpe, name, value)
    seen, real = [], bpe.slices
    monkeypatch.setattr(bpe, "slices", lambda *args: seen.append(args[4]) or real(*args))
    wants = [enc.encode_ordinary(t) for t in texts]
    for chunk, memo in ((1, 1), (1, 10**9), (3000, 2000), (10**9, 1)):
        monkeypatch.setattr(bpe, "CHUNK", chunk)
        monkeypatch.setattr(bpe, "VOCABULARY", memo)
        got = {r.doc_id: tuple(r)[1:3] for r in bpe.round_trip_digests(d, path, public_tokenizers.PATTERN).collect()}
        assert got == {i: (len(w), hashlib.sha256(",".join(map(str, w)).encode()).hexdigest()) for i, w in enumerate(wants)}
    assert set(seen) == {5}
    lists = real(d, path, public_tokenizers.PATTERN, bpe.work_path(spark, "lists"), 5).collect()
    assert max(Counter(r.slice for r in lists).values()) <= 1 + 5 and len({r.slice for r in lists}) == len(texts)
    dealt = Counter(w for r in lists if r.bucket >= 0 for w in bpe.unpacked_words(bytes(r.words)))
    assert dealt[b" zqxvzqxv"] == len(own) * 5 and not any(w in c.ranks for w in dealt)


def test_contamination_on_small_alphabets(spark):
    rng = np.random.default_rng(2)
    say = lambda n: " ".join(rng.choice(["a", "B", "c", "é", "x1"], n))
    items = [(i, say(rng.integers(0, 40))) for i in range(30)] + [(7, say(20)), (100, None), (101, "a, b"), (102, "!!")]
    texts = [None, "", "...", *(say(rng.integers(0, 60)) + "; " + items[rng.integers(30)][1] for _ in range(60))]
    d = spark.createDataFrame([(i, t, "n") for i, t in enumerate(texts)], "doc_id long, text string, items string")
    b = spark.createDataFrame(items, "item_id long, text string")
    got = [tuple(r)[1:] for r in decontam.contamination(d, b).orderBy("doc_id").collect()]
    assert got == brute_contamination(texts, items)
    many = decontam.judge(decontam.find_spans(d, b, most_words=10)).orderBy("row.doc_id").select("n_words", "n_hit", "n_items", "items_sha256", "contaminated")
    assert [tuple(r) for r in many.collect()] == got
    none = decontam.contamination(d, b.where("false")).agg({"n_hit": "sum"}).first()[0]
    assert none == 0 and decontam.contamination(d.where("false"), b).count() == 0


def test_contamination_on_documents(spark, sf_dir):
    d, b = (registry.table(spark, sf_dir, t) for t in ("documents", "benchmark"))
    rows = d.orderBy("doc_id").collect()
    got = [tuple(r)[1:] for r in decontam.contamination(d, b).orderBy("doc_id").collect()]
    want = brute_contamination([r.text for r in rows], [(r.item_id, r.text) for r in b.collect()])
    assert got == want and any(w[4] for w in want)


def test_excised_text_has_no_hits(spark):
    item = " ".join(f"w{i}" for i in range(20))
    d = spark.createDataFrame([(1, f"Keep this. {item.upper()}! And that."), (2, "clean")], "doc_id long, text string")
    b = spark.createDataFrame([(1, item)], "item_id long, text string")
    out = {r.doc_id: r.text for r in decontam.remove_spans(d, b).collect()}
    assert out == {1: "Keep this. ! And that.", 2: "clean"}


def test_crc_of_ids_is_of_u32(spark, tmp_path):
    records.write_token_records(docs(spark, ["hello"]).where("doc_id = 0"), str(tmp_path), public_tokenizers.path("word_bpe_49k.json"), 2)
    r = records.read_token_records(spark, str(tmp_path)).selectExpr("crc32(ids) c", "ids").first()
    assert r.c == zlib.crc32(bytes(r.ids)) and len(r.ids) % 4 == 0


def test_items_without_id_are_hit(spark):
    """As the SQL has it: their words are hit, they count as one item, and the digest has no id of them."""
    import hashlib

    long = " ".join(f"v{i}" for i in range(20))
    b = spark.createDataFrame([(None, long), (None, "two words"), (5, "other thing")], "item_id long, text string")
    d = spark.createDataFrame([(1, long), (2, "two words"), (3, "two words other thing"), (4, "clean")], "doc_id long, text string")
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    want = [(1, 20, 20, 1, sha(""), True), (2, 2, 2, 1, sha(""), True), (3, 4, 4, 2, sha("5"), True), (4, 1, 0, 0, sha(""), False)]
    assert [tuple(r) for r in decontam.contamination(d, b).orderBy("doc_id").collect()] == want
    many = decontam.judge(decontam.find_spans(d, b, most_words=1)).orderBy("row.doc_id")
    assert [(r.n_hit, r.n_items, r.items_sha256) for r in many.collect()] == [(x[2], x[3], x[4]) for x in want]
    assert [r.doc_id for r in decontam.clean(d, b).collect()] == [4]


def test_decoded_digest_comes_from_the_ids():
    """A wrong id of a word shows in the digest of the decoded bytes."""
    codec = bpe.Codec(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
    text = "Hello there"
    sha = hashlib.sha256(text.encode()).hexdigest()
    of_word = codec.words([w.encode() for w in codec.split(text)])
    shas = lambda: next(bpe.digests(codec, [1, None], np.array([len(of_word), 0]), np.arange(len(of_word)), of_word)).column("decoded_sha256").to_pylist()
    assert shas() == [sha, hashlib.sha256(b"").hexdigest()]
    of_word[-1] = codec.encode("wrong")
    assert shas()[0] != sha
