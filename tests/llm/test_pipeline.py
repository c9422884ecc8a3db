import corpus_pipeline
from anamnesis.llm import quality, toxicity
from anamnesis.llm.durable import ship, table
from anamnesis.llm.queries import remainder
from tests.llm.test_alike import jaccard, word_sets
from tests.llm.test_tokens import check_pieces

DIR = "/root/testdata/sf0.001"


def test_stages_against_brute_force(spark, vocab):
    ship(spark)
    docs, labels = table(spark, DIR, "documents"), table(spark, DIR, "labels")
    left = {r.doc_id: r.text for r in docs.collect()}
    toxic = toxicity.score(docs, toxicity.fit(docs, labels, lambda i: remainder(4)(i) != 2)).collect()
    left = {r.doc_id: left[r.doc_id] for r in toxic if r.score < 0.3}
    kept = docs.where(docs.doc_id.isin([*left]))
    good = quality.score(kept, quality.fit(kept, labels, lambda i: remainder(3)(i) != 1)).collect()
    left = {r.doc_id: left[r.doc_id] for r in good if r.score >= 0.5}
    sets = {i: word_sets(t) for i, t in left.items()}
    group = {}
    for i in sorted(left):  # the least id that is reached by pairs of the similarity
        near = {group[j] for j in group if jaccard(sets[i], sets[j]) >= 0.8}
        home = min(near, default=i)
        group = {j: home if g in near else g for j, g in group.items()} | {i: home}
    left = {i: left[i] for i in left if group[i] == i}
    rows = corpus_pipeline.run(spark, DIR).collect()
    assert {r.doc_id for r in rows} == set(left) and 0 < len(left) < docs.count()
    check_pieces(rows, left, vocab, 2048)


def test_stages_keep_columns_and_odd_rows(spark, documents):
    d = documents.select("doc_id", "text", "lang", "source", "n_chars")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, d, DIR)
        assert out.columns == d.columns
        assert stage(spark, d.limit(0), DIR).count() == 0
    kept = corpus_pipeline.drop_copies(spark, d, DIR)
    ids = [r.doc_id for r in kept.collect()]
    assert sorted(i for i in ids if i is not None) == [1, 2, 6, 7, 8] and None in ids
    assert [name for name, _ in corpus_pipeline.STAGES] == ["toxicity", "quality", "near-duplicates", "packing"]
