"""Quality, toxicity, near duplicates, packing and the pipeline against plain Python."""

from collections import Counter

import numpy as np
import plain
import pytest

from bitloom.llm import packing, quality, simhash, toxicity
from bitloom.llm.tokens import count_tokens
from bitloom.session import table

SF = "/root/testdata/sf0.001"
ODD = "doc_id bigint, text string, lang string, n_chars bigint, q int, r int, k int, i int, d int, node int, root int, f0 int, key int, c int, bin int, shard int, p_toxic int, is_toxic int, keep int, reason string"


def frame(spark, rows):
    """(doc_id, text, lang) with columns of the names that the operators use."""
    return spark.createDataFrame([(i, t, lang, 0, *range(15), "x") for i, t, lang in rows], ODD)


@pytest.fixture(scope="module")
def odd(spark):
    long = " ".join(f"w{i % 977}" for i in range(60_000))
    base = [(r.doc_id, r.text, r.lang) for r in table(spark, SF, "documents").limit(60).collect()]
    rows = base + [(None, None, "en"), (None, "", None), (7, " \n ", "en"), (7, "one two", None), (7, "one two", None), (8, long, "en"), (9, "@@@@ #### $$$$ " * 40, "en"), (None, "@@@@ #### $$$$ " * 40, "en"), (9, "short. Short, the", "en")]
    return rows, frame(spark, rows)


def test_quality_against_plain_python(spark, odd):
    rows, df = odd
    want = plain.judged([(lang, t) for _, t, lang in rows])
    got = quality.quality_scores(df).collect()
    key = lambda x: tuple(-1.0 if v is None else v for v in x)
    got = sorted(key((r.doc_id, r.n_chars, r.n_words, r.char_distance, r.word_distance, r.reason)) for r in got)
    want_rows = sorted(key((i, *w)) for (i, _, _), w in zip(rows, want))
    assert [(*g[:3], g[5]) for g in got] == [(*w[:3], w[5]) for w in want_rows]
    assert np.allclose([g[3:5] for g in got], [w[3:5] for w in want_rows], atol=1e-6)
    kept = quality.quality_filter(df)
    assert kept.schema == df.schema
    assert Counter(map(tuple, kept.collect())) == Counter(tuple(r) for r, w in zip(df.collect(), want) if w[-1] == "ok")
    assert quality.quality_filter(df.limit(0)).count() == quality.quality_scores(df.limit(0)).count() == 0


def test_packing_against_plain_python(spark, odd):
    rows, df = odd
    text_ids = spark.createDataFrame([("a", "b")], "doc_id string, text string")
    with pytest.raises(TypeError):
        packing.pack_documents(text_ids)
    many = df.unionByName(frame(spark, [(5, "the same words", "en")] * 500 + [(None, "no id", "en")] * 700))
    for rules in (packing.PackingRules(shard_documents=150), packing.PackingRules(score="norm", max_tokens=300, max_documents=4, max_attention=200 * 200)):
        got = packing.pack_documents(many, rules).collect()
        want: Counter = Counter()
        for r in count_tokens(many).collect():
            at = 0
            while at < r.n_tokens:  # cut only beyond what an empty bin holds
                n = min(plain.longest(rules), r.n_tokens - at)
                want[r.doc_id, at, n] += 1
                at += n
        assert Counter((r.doc_id, r.start_token, r.n_tokens) for r in got) == want
        shards: dict = {}
        for r in got:
            shards.setdefault(r.shard, []).append(r)
        assert len(shards) == 1 if rules.shard_documents > 1000 else 6 <= len(shards) <= 9
        assert all(len({(r.doc_id, r.piece) for r in s}) > 1 for s in shards.values())
        for s in shards.values():
            s.sort(key=lambda r: (-r.n_tokens, r.doc_id is None, r.doc_id or 0, r.piece, r.bin))
            bins = plain.best_fit([r.n_tokens for r in s], rules)
            # equal rows may change places
            group = lambda b: Counter((r.n_tokens, r.doc_id, r.piece, k) for r, k in zip(s, b))
            assert group(bins) == group([r.bin for r in s])


def test_simhash_against_all_pairs(spark, odd):
    rows, df = odd
    rows = rows + [(100 + k, (rows[3][1] or "") + f" extra{k}", "en") for k in range(30)] + [(100, rows[5][1], "en"), (1, rows[9][1], "en")]
    df = frame(spark, rows)
    group = plain.near_groups([r[:2] for r in rows])
    want = Counter((k[0], g[0]) for k, g in group.items() if g != k)
    for rules in (simhash.SimHashRules(), simhash.SimHashRules(bucket_cap=8, bucket_rows=4, bits=2, recall=0.999)):
        got = Counter((r.doc_id, r.keep_id) for r in simhash.near_duplicates(df, rules).collect())
        assert got == want
    kept = simhash.keep_one_of_each_group(df)
    assert kept.schema == df.schema
    from bitloom.llm.textops import text_key

    node = lambda r: (r[0], text_key(r[1].encode())) if r[0] is not None and r[1] is not None else None
    once = {r for r in rows if node(r) in group}
    expected = Counter(r[:2] for r in rows if node(r) not in group) + Counter(r[:2] for r in once if group[node(r)] == node(r))
    assert Counter((r.doc_id, r.text) for r in kept.collect()) == expected
    assert simhash.keep_one_of_each_group(df.limit(0)).count() == 0
    with pytest.raises(TypeError):
        simhash.near_duplicates(df.selectExpr("cast(doc_id as string) doc_id", "text"))


def test_simhash_recall_follows_the_tables():
    rules = simhash.SimHashRules()
    rng = np.random.default_rng(1)
    for n in (10**5, 10**8, 10**10):
        bits, tables = rules.plan(n)
        order = simhash.sampled_bits(tables, 3)[:, :bits]
        far = np.stack([rng.permutation(simhash.BITS)[: rules.max_distance] for _ in range(400)])
        missed = [not (~np.isin(order, f)).all(1).any() for f in far]
        assert np.mean(missed) < 0.12


def test_toxicity_scores_against_plain_python(spark, odd):
    rows, df = odd
    docs = df.unionByName(frame(spark, [(1000 + k, ("vile rotten words " if k % 2 else "kind good words ") + f"text {k % 7}", "en") for k in range(60)]))
    labels = spark.createDataFrame([(1000 + k, k % 2) for k in range(60)] + [(1000, None), (1001, 0), (10**6, 1), (None, 1), (7, 1), (7, 1)], "doc_id bigint, toxic int")
    rules = toxicity.ToxicityRules(min_feature_rows=2)
    chain = toxicity.train(docs, labels, rules)
    again = toxicity.train(docs.repartition(5), labels.repartition(3), rules)
    assert all(np.array_equal(a, b) for a, b in zip(chain.weights, again.weights))
    where = {int(h): k for k, h in enumerate(chain.keys)}
    got = toxicity.toxicity_scores(docs, labels, rules).collect()
    seen = Counter()
    for r, (i, t) in zip(sorted(got, key=repr), sorted(((x.doc_id, x.text) for x in docs.select("doc_id", "text").collect()), key=repr)):
        seen[i] += 1
    score = {}
    for i, t in {(x.doc_id, x.text) for x in docs.select("doc_id", "text").collect()}:
        p = []
        for w in chain.weights:
            s = w[-1] + sum(w[where[int(h)]] for h in toxicity.features(t) if int(h) in where) + sum(w[len(chain.keys) + k] * x for k, x in enumerate(p))
            p.append(1 / (1 + np.exp(-np.clip(s, -30, 30))))
        score.setdefault(i, set()).add(tuple(round(x, 5) for x in p))
    for r in got:
        assert any(np.allclose(tuple(r)[1:-1], x, atol=2e-5) for x in score[r.doc_id])
        assert r.is_toxic == (r.p_toxic >= rules.threshold)
    assert {r.doc_id for r in got if r.is_toxic and r.doc_id and r.doc_id >= 1000} == {1000 + k for k in range(60) if k % 2}
    kept = toxicity.toxicity_filter(docs, labels, rules)
    assert kept.schema == docs.schema
    bad = {r.doc_id for r in got if r.is_toxic}
    assert not bad & {r.doc_id for r in kept.collect()} - {7, 9, None} and kept.count() == len(got) - sum(r.is_toxic for r in got)


@pytest.mark.parametrize("labels", [[], [(1, 1), (2, 1)], [(1, 0)], [(1, 0), (1, 1)]])
def test_toxicity_without_both_kinds_of_labels(spark, odd, labels):
    df = odd[1]
    got = toxicity.toxicity_scores(df, spark.createDataFrame(labels, "doc_id bigint, toxic int")).collect()
    assert len({tuple(r)[1:] for r in got}) == 1 and got[0].is_toxic == (len(labels) == 2 and labels[1][0] == 2)


def test_features_of_letters_not_bytes():
    assert len(toxicity.features("éééééé")) == 3 and len(toxicity.features("é")) == 1
    assert set(toxicity.features("schimpfen")) & set(toxicity.features("schimpft"))


def test_copies_share_a_fold(spark):
    # each toxic text is there twice; a model that has seen the copy would be sure of it
    docs = spark.createDataFrame([(k, f"word{k // 2} other{k // 2}") for k in range(40)], "doc_id bigint, text string")
    labels = spark.createDataFrame([(k, (k // 2) % 2) for k in range(40)], "doc_id bigint, toxic int")
    chain = toxicity.train(docs, labels, toxicity.ToxicityRules(min_feature_rows=1))
    # out of fold such rows can't be told apart, so earlier categories get no great weight
    assert np.abs(chain.weights[-1][len(chain.keys) : -1]).max() < 2


@pytest.mark.parametrize("source", ["table", "messy"])
def test_pipeline_against_plain_python(spark, odd, source, tmp_path):
    import corpus_pipeline

    sf = SF
    if source == "messy":
        sf = str(tmp_path)
        table(spark, SF, "labels").write.parquet(f"{sf}/labels.parquet")
        passage = " ".join(f"shared{i}" for i in range(60))
        rows = odd[0] + [(200, f"start here {passage} and end", "en"), (201, f"{passage} tail words follow", "de"), (None, passage, "en")]
        frame(spark, rows).write.parquet(f"{sf}/documents.parquet")
    docs = table(spark, sf, "documents")
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, sf)
        rows = [(r.doc_id, r.text) for r in docs.collect()]
        if name != "best-fit packing":
            assert out.columns == docs.columns
            got = Counter((r.doc_id, r.text) for r in out.collect())
        if name == "quality rules":
            langs = [r.lang for r in docs.select("lang").collect()]
            want = Counter(r for r, w in zip(rows, plain.judged([(lang, t) for lang, (_, t) in zip(langs, rows)])) if w[-1] == "ok")
        elif name == "toxicity":
            bad = Counter()
            scores = toxicity.toxicity_scores(docs.withColumn("doc_id", docs.doc_id), table(spark, sf, "labels")).where("is_toxic").collect()
            bad = Counter(r.doc_id for r in scores)
            want = got
            assert Counter(i for i, _ in rows) - Counter(i for i, _ in got.elements()) == bad
        elif name == "simhash near-dedup":
            group = plain.near_groups(rows)
            from bitloom.llm.textops import text_key

            node = lambda r: (r[0], text_key(r[1].encode())) if r[0] is not None and r[1] is not None else None
            want = Counter(r for r in rows if node(r) not in group) + Counter(r for r in set(rows) if node(r) in group and group[node(r)] == node(r))
        elif name == "suffix-array dedup":
            from bitloom.llm.textops import text_key

            gone = plain.repeats(rows)
            want = Counter()
            for i, t in rows:
                cut = gone.get((i, text_key(" ".join(t.split()).encode()))) if i is not None and t is not None else None
                if cut:
                    t = " ".join(w for k, w in enumerate(t.split()) if k not in cut)
                    if not t:
                        continue
                want[i, t] += 1
        else:
            packed = Counter()
            for r in out.collect():
                packed[r.doc_id] += r.n_tokens
            want = Counter()
            for r in count_tokens(docs).collect():
                want[r.doc_id] += r.n_tokens
            got = packed
            want = +want
        assert got == want, name
        docs = out
    assert corpus_pipeline.run(spark, sf).count() == out.count()
