import random

from policylog.llm import decontaminate as dc


def words(rng, n):
    return [f"w{rng.randrange(10**6)}" for _ in range(n)]


def found(spark, docs, items):
    df = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string")
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    return {(r.doc_id, r.item_id) for r in dc.contaminated(df, bench).collect()}


def test_altered_copies_in_a_hot_group(spark):
    """A fifth of the documents hold one item with the same words altered: its words are frequent, the lacking ones rare."""
    rng = random.Random(8)
    for lacking in (1, 3):
        items = [words(rng, 48) for _ in range(5)]
        docs = [words(rng, 150) for _ in range(200)]
        copy = list(items[0])
        for k in range(lacking):
            copy[5 + 15 * k] = words(rng, 1)[0]
        for d in docs[:40]:
            d[20:20] = copy
        assert found(spark, [" ".join(d) for d in docs], [" ".join(i) for i in items]) == {(d, 0) for d in range(40)}


def test_verbatim_copies_of_over_a_thousand_items(spark):
    """More passages in a block than the latent space has dimensions; items are cut from the documents themselves."""
    rng = random.Random(9)
    rows = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").orderBy("doc_id").collect()
    items, docs, want = [], [], set()
    for text in [r.text for r in rows if len(dc.words_of(r.text)) >= 60]:
        own = dc.words_of(text)
        for _ in range(2):
            n = rng.randrange(10, 21)
            at = rng.randrange(len(own) - n)
            want.add((len(docs), len(items)))
            items.append(own[at : at + n])
        docs.append(own)
    assert len(items) > 1_000
    got = found(spark, [" ".join(d) for d in docs], [" ".join(i) for i in items])
    assert want <= got


def test_few_documents_take_the_same_path(spark):
    rng = random.Random(10)
    item, line = words(rng, 30), words(rng, 30)
    altered = [*item[:9], "other", *item[10:]]
    for n in (3, 18, 19, 20, 40):
        docs = [" ".join(words(rng, 50) + altered) for _ in range(n)] + [" ".join(line)]
        assert found(spark, docs, [" ".join(item)]) == {(d, 0) for d in range(n)}
