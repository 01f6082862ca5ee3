import random

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from policylog.llm.bpe import PieceEncoder

FILES = [("byte_bpe_50k.json", "leading"), ("word_bpe_49k.json", "dropped")]
HARD = ["", " ", "\n", "a", " a", "a ", "a  b", "a\n\nb", "a \n b", "\n\na", "x\t\ty \t z", "don't we'll\n's", "<|endoftext|>", "a <|endoftext|> b", "a<|endoftext|>  b",
        "  lead", "tail  ", "　a　 b", "a\x1c b\x1c\n c", "a\xa0 b", "\0nul \0 a\0", "é́ ñ ́x", "ÀÉ ẞ İ Σς", "12 345\n6789", "!!! ... ##\n##", "日本語 テキスト", "a\r\nb\r\n", "🙂 👍🏽"]


def texts(n=300):
    rng = random.Random(3)
    alphabet = ["a", "B", "é", "1", " ", " ", "\n", "\t", "'s", ".", "　", "\x1c", "\xa0", "<|endoftext|>", "word", "日", "\0"]
    return HARD + ["".join(rng.choices(alphabet, k=rng.randrange(30))) for _ in range(n)]


@pytest.mark.parametrize("file,cut", FILES)
def test_pieces_give_the_librarys_ids(file, cut):
    import numpy as np

    path = public_tokenizers.path(file)
    encoder, whole = PieceEncoder(path, cut), Tokenizer.from_file(path)
    for text, ids in zip(texts(), encoder.encode(texts()), strict=True):
        assert np.frombuffer(ids, encoder.dtype).tolist() == whole.encode(text, add_special_tokens=False).ids, repr(text)


def test_counts_equal_the_librarys(spark, monkeypatch):
    import policylog.llm.token_counts as tc

    monkeypatch.setattr(tc, "BLOCK_CHARS", 300)
    path = public_tokenizers.path("byte_bpe_50k.json")
    whole = Tokenizer.from_file(path)
    rows = [(i, t) for i, t in enumerate(texts(100) + ["the cat sat " * 3000])] + [(7000, None), (7001, ""), (None, "null id"), (5, "again"), (5, "again")]
    df = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, n_tokens int").repartition(3)
    got = sorted(map(str, tc.count_tokens(df, path, "leading").collect()))
    from pyspark.sql import Row

    want = sorted(str(Row(doc_id=i, n_bytes=len((t or "").encode()), n_tokens=len(whole.encode(t or "", add_special_tokens=False).ids))) for i, t in rows)
    assert got == want
    assert tc.count_tokens(df.limit(0), path).count() == 0


def test_store_round_trip(spark, tmp_path):
    import zlib

    import numpy as np

    from policylog.llm.token_store import TokenStore, read_store, remove_store, write_store

    path = public_tokenizers.path("byte_bpe_50k.json")
    whole = Tokenizer.from_file(path)
    rows = [(i * 7 % 1009 - 300, t) for i, t in enumerate(texts(200) + ["the cat sat " * 3000])] + [(5000, None), (5001, ""), (None, "null id"), (9, "again"), (9, "again"), (9, "and more")]
    df = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, start int").repartition(3)
    folder = write_store(df, path, str(tmp_path / "store"), shards=5)
    ids = lambda t: [*whole.encode(t or "", add_special_tokens=False).ids, 0]
    got = sorted(read_store(df, folder, with_ids=True).collect(), key=lambda r: r.start)
    assert sorted((str(r.doc_id), r.ids) for r in got) == sorted((str(i), ids(t)) for i, t in rows)
    assert [r.doc_id for r in got] == sorted((i for i, _ in rows), key=lambda i: (i is not None, i or 0))
    at = 0
    for r in got:
        assert (r.start, r.n_tokens) == (at, len(r.ids)) and r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes())
        at += r.n_tokens
    store = TokenStore(folder)
    for key in {i for i, _ in rows if i is not None}:
        assert sorted(x.tolist() for x in store.get(key)) == sorted(ids(t) for i, t in rows if i == key)
    assert not any(store.get(k) for k in range(2000, 2500))
    some = read_store(df.where("doc_id % 10 = 9 or doc_id = 5000"), folder, with_ids=True).collect()
    assert sorted((r.doc_id, r.ids) for r in some) == sorted((i, ids(t)) for i, t in rows if i is not None and (i >= 0 and i % 10 == 9 or i == 5000))
    assert read_store(df.limit(0), write_store(df.limit(0), path, str(tmp_path / "none"))).count() == 0
    for lacking in ("4L", "100000L"):
        with pytest.raises(Exception, match="not in the store"):
            read_store(spark.range(1).selectExpr(f"{lacking} as doc_id"), write_store(df.where("doc_id <> 4"), path, str(tmp_path / lacking))).collect()
    remove_store(folder)
    assert not (tmp_path / "store").exists()


def test_a_wrong_slot_is_noticed(spark, tmp_path):
    """The hash is the only way to a document: a damaged displacement or fingerprint can't go unseen."""
    import json

    import numpy as np

    from policylog.llm.token_store import _HEADER, MAGIC, ShardIndex, read_store, write_store

    df = spark.range(40).selectExpr("id as doc_id", "repeat('word ', cast(id as int)) as text")
    folder = write_store(df, public_tokenizers.path("byte_bpe_50k.json"), str(tmp_path / "store"), shards=1)
    [shard] = json.loads((tmp_path / "store" / "manifest.json").read_text())["shards"]
    file = tmp_path / "store" / shard["idx_file"]
    whole = file.read_bytes()
    index = ShardIndex(whole)
    (first,), (times,) = index.find(np.array([7], np.int64))
    assert (first, times) == (7, 1) and read_store(df, folder).count() == 40
    at = len(MAGIC) + _HEADER.size + index.offsets.nbytes
    for begin, size in ((at, index.hash.displacement.nbytes), (len(whole) - index.prints.nbytes, index.prints.nbytes)):
        file.write_bytes(whole[:begin] + bytes(b ^ 1 for b in whole[begin : begin + size]) + whole[begin + size :])
        with pytest.raises(Exception, match="not in the store"):
            read_store(df, folder).collect()


def test_perfect_hash_is_minimal():
    import numpy as np

    from policylog.llm.token_store import PerfectHash

    for n in (0, 1, 2, 5, 1000):
        keys = np.unique(np.random.default_rng(n).integers(-(2**62), 2**62, n))
        assert sorted(PerfectHash.build(keys).slots(keys).tolist()) == list(range(len(keys)))
