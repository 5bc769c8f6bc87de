import json
import zlib

import numpy as np
import pyarrow as pa
import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from quantframe.llm import packing, tokens
from quantframe.llm.tokens import WordTokens

TOKENIZER = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
OWN = WordTokens()


def plain(text):
    return TOKENIZER.encode(text or "", add_special_tokens=False).ids + [0]


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.sampled_from(list("abcXYZéÉßİΣς 's.,!<|>0 9\n\t\x0b\x85́̀ﬁ一가ᄀ‍")) | st.characters(codec="utf-8")))
def test_cached_ids_equal_the_tokenizers(text):
    assert np.frombuffer(OWN.ids(text), "<u4").tolist() + [0] == plain(text)


def test_special_strings_and_small_cache(monkeypatch):
    import quantframe.llm.tokens as tokens

    monkeypatch.setattr(tokens, "CACHED", 5)
    own = WordTokens()
    for text in ["a<|endoftext|>b", "<|startoftext|> x <|end", "one two three four five six seven eight nine", "it's they'LL Don't.", "one, two; x: y? z!"]:
        assert np.frombuffer(own.ids(text), "<u4").tolist() == plain(text)[:-1]


def whole(rows, capacity=2048):
    by = {}
    for r in rows:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in by.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    return len(by)


def test_query_packs_every_token_once(spark, sf_dir):
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    rows = packing.query(spark, sf_dir).collect()
    mine = {(r["doc_id"], r["piece"]): r for r in rows}
    assert len(mine) == len(rows)
    total = 0
    for i, text in docs.items():
        ids = plain(text)
        total += len(ids)
        for k, s in enumerate(range(0, len(ids), 2048)):
            r, part = mine.pop((i, k)), ids[s : s + 2048]
            assert (r["start"], r["length"], r["ids_crc32"]) == (s, len(part), zlib.crc32(np.array(part, "<u4").tobytes()))
    assert not mine
    assert whole(rows) <= -(-total // 2048) * 1.02 + 1


def test_plan_uses_each_piece_once_and_is_near_the_bound():
    rng = np.random.default_rng(0)
    for n in (0, 1, 50, 3000, 200_000):
        lengths = np.minimum(2048, np.maximum(1, rng.lognormal(6.3, 1.1, n).astype(int)))
        counts = np.bincount(lengths, minlength=2049)
        plan = packing.plan_packing(counts)
        assert (plan.left == 0).all() and (plan.used == counts).all()
        filled = {}
        for k, _, times, repeats, seq, offset in plan.entries:
            filled.setdefault(seq, []).append((offset, k * times, repeats))
        for parts in filled.values():
            assert sum(x[1] for x in parts) <= 2048 and len({x[2] for x in parts}) == 1
        assert plan.sequences <= -(-lengths.sum() // 2048) * 1.01 + 2
        assert len(plan.entries) < 60_000


def test_least_squares_solves_small_systems():
    rng = np.random.default_rng(1)
    a, x = rng.random((8, 5)), np.array([1.0, 0, 2, 0, 3])
    assert np.allclose(packing.nnls(a, a @ x), x, atol=1e-6)
    got = packing.nnls(np.eye(3), np.array([1.0, -2, 3]))
    assert np.allclose(got, [1, 0, 3])


def test_nulls_repeats_long_names_empty_and_sequences(spark):
    rows = [(1, None, 5), (1, None, 5), (2, "", 6), (None, "a b c", 7), (3, "word " * 9000, 8)]
    df = spark.createDataFrame(rows, "doc_id long, text string, length int")
    got = packing.pack_documents(df).collect()
    whole(got)
    assert sorted((r["doc_id"] or 0, r["piece"]) for r in got) == sorted([(1, 0), (1, 0), (2, 0), (0, 0), *((3, k) for k in range(5))])
    assert packing.pack_documents(df.limit(0)).collect() == []
    one = df.filter("doc_id > 1")
    seqs = packing.build_sequences(one, packing.pack_documents(one)).collect()
    ids = sorted(np.concatenate([np.frombuffer(s["ids"], "<u4") for s in seqs]).tolist())
    assert ids == sorted(plain("word " * 9000) + [0]) and all(len(s["ids"]) == 4 * s["n_tokens"] <= 8192 for s in seqs)


def test_worker_keeps_the_last_used_words(monkeypatch):
    """The cache that a worker keeps is bounded with all that it holds, and words in use aren't encoded again when it turns over."""
    monkeypatch.setattr(tokens, "CACHED", 200)
    own, learnt, letters = tokens.WordTokens(), [], "abcdefghij"
    real = own.learn
    monkeypatch.setattr(own, "learn", lambda words: (learnt.append("Always," in own.known or "Always," in own.known.before), real(words))[1])
    for i in range(300):
        text = "Always, " + " ".join("q" + "".join(letters[int(d)] for d in str(10 * i + k)) for k in range(10))
        assert own.ids(text) == own.encoded(text)
        assert sum(len(x) for x in vars(own).values() if isinstance(x, dict)) + len(own.known.before) < 250
    assert len(learnt) == 300 and all(learnt[1:])


def test_large_batches_are_taken_in_slices(monkeypatch):
    """A batch of much text is tokenised and scored part by part, with the same rows."""
    texts = [f"plain words number {i} " * 400 for i in range(400)] + [None, "", "word " * 600_000]
    batch = pa.record_batch([pa.array(range(len(texts))), pa.array(texts)], names=["doc_id", "text"])
    out = list(packing.cut(None, 2048, False)(iter([batch])))
    assert len(out) > 2 and sorted(set(i for b in out for i in b.column(0).to_pylist())) == list(range(len(texts)))
    small = [list(packing.cut(None, 2048, False)(iter([batch.slice(i, 1)])))[0].to_pylist() for i in range(len(texts))]
    assert [r for b in out for r in b.to_pylist()] == [r for rows in small for r in rows]


def test_parts_of_known_words_need_no_encoder(monkeypatch):
    """Words in capitals, with marks around them or in another order are put together from known parts."""
    own = WordTokens()
    own.ids("always never déjà 's ! . *** 7")
    text = "ALWAYS!*** Never*** (never.7) Déjà's, always.***\tNEVER'S!"
    own.ids("( ) , .*** !*** .7")
    want = own.encoded(text)
    monkeypatch.setattr(own, "tokenizer", None)
    monkeypatch.setattr(own, "model", None)
    assert own.ids("Never*** ALWAYS. 'S déjà! 77") and own.ids(text) == want


def test_all_pairs_of_latin_characters():
    own = WordTokens()
    for a in range(256):
        text = "".join(f"x{chr(a)}{chr(b)}q, {chr(b)}{chr(a)}'{chr(b)} " for b in range(256))
        for part in (text, text.replace("<", "'"), text.replace("<", ",")):
            assert own.ids(part) == own.encoded(part), a


def test_other_tokenizers_encode_whole_texts(tmp_path):
    """Nothing is put together for a tokenizer whose steps aren't known, such as one that keeps capitals."""
    spec = json.loads(open(public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8").read())
    spec["normalizer"] = None
    path = tmp_path / "other.json"
    path.write_text(json.dumps(spec), encoding="utf-8")
    own = WordTokens(str(path))
    for text in ["Always always ALWAYS, one", "It's IT'S"]:
        assert own.ids(text) == own.encoded(text)
    assert own.ids("Always") != own.ids("always")
