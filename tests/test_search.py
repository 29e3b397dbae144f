"""Searches, dictionaries and indexes against plain Python."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from spindrift.functions import constants as K
from spindrift.operators import dictionary, feedback, retrieval, search
from spindrift.plans import catalog, registry


def unit(counts, idf):
    w = {t: (1 + math.log(n)) * idf[t] for t, n in counts.items() if t in idf}
    norm = math.sqrt(sum(x * x for x in w.values()))
    return {t: x / norm for t, x in w.items()}


def grams(text):
    words = [w for w in re.findall(r"\w{2,}", text.lower()) if w not in registry.STOP_WORDS]
    return Counter(words + [f"{a} {b}" for a, b in zip(words, words[1:], strict=False)])


def plain_chat(docs, asked, net):
    """The documents of each chat turn, in order: searched, filtered, spread and sorted with lists and loops."""
    counts = {d["doc_id"]: grams(d["text"]) for d in docs}
    cf, df = Counter(), Counter()
    for c in counts.values():
        cf.update(c)
        df.update(c.keys())
    kept = sorted(cf, key=lambda t: (-cf[t], t.encode()))[: registry.MOST_TERMS]
    idf = {t: math.log((1 + len(docs)) / (1 + df[t])) + 1 for t in kept}
    own = {d: unit(c, idf) for d, c in counts.items()}
    by_id = {d["doc_id"]: d for d in docs}
    for q in asked:
        want = dict(zip(("countries", "states", "setting", "study_type", "statuses", "sponsors", "classes"), registry.ASKED[q["qid"] % len(registry.ASKED)][1:8], strict=True))
        said = q["text"]
        names = any(re.search(p, said.lower()) for _, p in K.DISEASES)
        told = f"{q['disease']} — {said}" if q["disease"] and not names else said
        attributes = bool(want["study_type"] or want["statuses"] or want["sponsors"] or want["classes"])
        some = attributes or bool(want["countries"] or want["states"] or want["setting"])
        if some:
            drugs = list(dict.fromkeys(d for c in want["classes"] for d in K.CLASS_DRUGS[c] if d.lower() not in told.lower()))
            told = " ".join([told, *drugs])
        size = 1600 if attributes else 800 if some else 240
        w = unit(grams(told), idf)
        scored = [(round(sum(x * own[d].get(t, 0.0) for t, x in w.items()), 6), d) for d in own]
        pool = sorted(((-s, d) for s, d in scored if s > 0))[:size]
        rows = [(rank, -s, by_id[d]) for rank, (s, d) in enumerate(pool, 1)]

        def meets(d, want=want):
            setting = {"metastatic": "Metastatic" in d["conditions"], "neoadjuvant": "Neoadjuvant" in d["conditions"], None: True}[want["setting"]]
            places = [x.lower() for x in want["states"]]
            return (
                (not want["countries"] or any(c in d["locationCountries"] for c in want["countries"])) and (not places or any(p in d["locationInfoFull"].lower() for p in places)) and setting
                and want["study_type"] in (None, d["studyType"]) and (not want["statuses"] or d["status"] in want["statuses"]) and (not want["sponsors"] or any(s in d["sponsorName"].lower() for s in want["sponsors"]))
            )

        fits = [r for r in rows if meets(r[2])]
        ladder = []
        if want["classes"]:
            ladder = [[r for r in fits if set(want["classes"]) <= set(r[2]["drug_classes"])], [r for r in fits if set(want["classes"]) & set(r[2]["drug_classes"])]]
        rows = next((step for step in [*ladder, fits] if step), rows)
        rows = sorted(((rank, s + 0.05 * math.tanh(net.get(d["doc_id"], 0.0)), d) for rank, s, d in rows), key=lambda r: (-r[1], r[0]))[:80]
        like = [r for r in rows if (not q["phase"] or r[2]["phases"] == q["phase"]) and (not q["status"] or r[2]["status"] == q["status"])]
        rows = like or rows
        queues = {}
        for i, r in enumerate(rows):
            for c in r[2]["drug_classes"] or ["(other)"]:
                queues.setdefault(c, []).append(i)
        taken = []
        while len(taken) < 12 and any(i not in taken for x in queues.values() for i in x):
            for x in queues.values():
                free = [i for i in x if i not in taken]
                if free and len(taken) < 12:
                    taken.append(free[0])
        order = sorted((rows[i] for i in taken), key=lambda r: (r[2]["sponsorClass"] != "INDUSTRY", r[2]["status"] != "RECRUITING", -r[1], r[0]))
        yield from ((q["qid"], d["doc_id"], place) for place, (_, _, d) in enumerate(order, 1))


def test_chat_equals_plain_lists(spark, sf_dir):
    docs = [r.asDict() for r in registry.trial_docs(spark, sf_dir).collect()]
    asked = [r.asDict() for r in registry.chat_questions(spark, sf_dir).collect()]
    votes = feedback.source_scores(catalog._votes(spark, sf_dir), F.lit(catalog.NOW).cast("timestamp")).collect()
    net = {f"NCT{r['doc_id'].zfill(8)}": r["net"] for r in votes}
    got = {(r["qid"], r["doc_id"], r["place"]) for r in registry.chat_retrieve(spark, sf_dir).collect()}
    want = set(plain_chat(docs, asked, net))
    assert len(got & want) >= 0.99 * len(want) and len(got) == len(want)  # scores that round apart may swap two neighbours


def test_blocks_are_skipped_and_nothing_is_lost(spark):
    draw = random.Random(5)
    topics = [[f"t{k}w{i}" for i in range(12)] for k in range(25)]
    docs = spark.createDataFrame([(i, " ".join(draw.choices(topics[i % 25], k=draw.randint(3, 40)) + ["common"])) for i in range(1500)], "doc_id long, text string")
    asked = spark.createDataFrame([(i, " ".join(draw.choices(topics[i % 25], k=4) + ["common"])) for i in range(30)] + [(99, "nothing of it")], "qid long, text string")
    index = retrieval.indexed(docs, "doc_id", "text", block_docs=16)
    q = index.asked(asked, "qid", "text")
    got = retrieval.pruned_top_k(q, index, 5)
    want = retrieval.top_k(retrieval.sparse_scores(q, index.postings()).withColumn("score", F.round("score", 6)), 5)
    assert sorted(map(tuple, got.select("qid", "doc_id", "score", "rank").collect())) == sorted(map(tuple, want.select("qid", "doc_id", "score", "rank").collect()))
    assert retrieval.share_read(q, index) < 0.5
    lonely = retrieval.indexed(docs.limit(0), "doc_id", "text")
    assert retrieval.pruned_top_k(lonely.asked(asked, "qid", "text"), lonely, 5).count() == 0


def test_lists_find_nearly_all(spark):
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(20, 16))
    data = [(i, (centres[i % 20] + 0.4 * rng.normal(size=16)).tolist()) for i in range(3000)]
    rows = spark.createDataFrame(data, "doc_id long, e array<double>").select("doc_id", retrieval.normalised(F.col("e")).alias("v"))
    asked = rows.filter("doc_id % 50 = 0").select(F.col("doc_id").alias("qid"), F.col("v").alias("q"))
    exact = {(r["qid"], r["doc_id"]) for r in retrieval.dense_top_k(asked, rows, 10).collect()}
    lists = retrieval.in_lists(rows)
    assert lists.packs.select(F.sum(F.size("rows"))).head()[0] == 3000  # every vector is in a list
    found = {(r["qid"], r["doc_id"]) for r in lists.top_k(asked, 10).collect()}
    assert len(exact & found) >= 0.9 * len(exact) and lists.probe < len(lists.centroids) / 2
    assert retrieval.in_lists(rows.limit(0)) is None
    one = retrieval.in_lists(rows.limit(1))
    assert one.top_k(asked.limit(3), 10).count() <= 3


def test_recall_of_the_registered_lists(spark):
    got = catalog.dense_topk_lists(spark, "/root/testdata/sf0.01").collect()
    assert sum(r["exact"] for r in got) >= 0.9 * 10 * len({r["qid"] for r in got})


def plain_names(text, names):
    """Longest aliases first, words taken out: with a loop over all aliases."""
    words = re.findall(r"\w+", text.lower())
    places = sorted((-len(a), -len(" ".join(a)), i, a) for a in names for i in range(len(words) - len(a) + 1) if tuple(words[i : i + len(a)]) == a)
    used, out = set(), set()
    for n, _, i, a in places:
        own = set(range(i, i - n))
        if not own & used:
            used |= own
            out.add(names[a])
    return sorted(out)


@pytest.mark.parametrize("few", [0, 200_000])
def test_a_hundred_thousand_aliases(spark, few):
    draw = random.Random(9)
    names = {}
    for i in range(100_000):
        names.setdefault(tuple(f"w{draw.randint(0, 300)}" for _ in range(draw.randint(1, 4) if i % 50 else 1)), f"N{i}")
    rows = [(" ".join(a).upper() if draw.random() < 0.5 else "  ".join(a), n) for a, n in names.items()]
    texts = [(i, ", ".join(f"W{draw.randint(0, 320)}" for _ in range(draw.randint(0, 30)))) for i in range(60)] + [(60, None), (61, "")]
    found = dictionary.hits(spark.createDataFrame(texts, "id long, text string"), "id", "text", spark.createDataFrame(rows, "alias string, canonical string"), few)
    got = dictionary.longest_first(found, "id").groupBy("id").agg(F.array_sort(F.collect_set("canonical")).alias("names"))
    by_size = {n: {a: v for a, v in names.items() if len(a) == n} for n in range(1, 5)}
    held = lambda words: {a: by_size[n][a] for n in by_size for i in range(len(words)) if (a := tuple(words[i : i + n])) in by_size[n]}
    want = {i: plain_names(t, held(re.findall(r"\w+", t.lower()))) for i, t in texts if t}
    assert {r["id"]: r["names"] for r in got.collect()} == {i: n for i, n in want.items() if n}


def test_widened_texts(spark):
    names = spark.createDataFrame([("T-DXd", "Trastuzumab deruxtecan"), ("dxd", "Deruxtecan"), (" ", "x"), ("her2", "HER2 ")], "alias string, canonical string")
    texts = spark.createDataFrame([(1, "trials of t dxd in HER2"), (2, "none"), (3, None)], "id long, text string")
    got = {r["id"]: (r["names"], r["widened"]) for r in dictionary.expanded(texts, "id", "text", names).collect()}
    assert got == {1: (["HER2", "Trastuzumab deruxtecan"], "trials of t dxd in HER2 Trastuzumab deruxtecan"), 2: ([], "none"), 3: ([], None)}
    with pytest.raises(ValueError):
        dictionary.hits(texts, "id", "text", spark.createDataFrame([("a b c d e f g h i", "x")], "alias string, canonical string"))


def test_what_queries_ask_for_bounds_their_pools(spark):
    asked = spark.createDataFrame([(1, "PARP inhibitor"), (2, "in Japan"), (3, "anything")], "qid long, text string")
    assert {r["qid"]: r["pool"] for r in search.wanted(asked).collect()} == {1: 200, 2: 50, 3: 5}
    assert {r["qid"]: r["pool"] for r in search.wanted(asked, with_feedback=True).collect()} == {1: 200, 2: 50, 3: 20}


def test_a_search_sends_on_its_best_rows_alone(spark):
    """Rows that tasks send on are those of the result, not all pairs of queries and documents; what a document's terms sum to is found in one task."""
    draw = random.Random(3)
    words = [f"w{i}" for i in range(300)]
    docs = spark.createDataFrame([(f"D{i:05}", " ".join(draw.choices(words, k=30))) for i in range(3000)] + [("D00007", "w1 w1 again"), ("empty", None)], "doc_id string, text string")
    asked = spark.createDataFrame([(i, " ".join(draw.choices(words, k=20))) for i in range(40)], "qid long, text string")
    index = retrieval.indexed(docs, "doc_id", "text", most=250, stop_words=["w3"], bigrams=True)
    q = index.asked(asked, "qid", "text")
    want = retrieval.top_k(retrieval.sparse_scores(q, index.postings()).withColumn("score", F.round("score", 6)), 7)
    for pack in (512, 8):
        found = retrieval.pruned_top_k(q, index, 7, query_pack=pack)
        assert {(r["qid"], r["doc_id"]): (r["score"], r["rank"]) for r in found.collect()} == {(r["qid"], r["doc_id"]): (r["score"], r["rank"]) for r in want.collect()}
    assert {r["doc_id"]: sum(c["tf"] for c in r["counts"]) for r in retrieval.counted(docs, "doc_id", "text").collect()}["D00007"] == 33
    assert index.rows.count() == docs.filter("text IS NOT NULL").select("doc_id").distinct().count()


def test_frequent_terms_are_those_of_full_counts(spark):
    draw = random.Random(4)
    rows = [(i, f"t{int(draw.paretovariate(0.7))}", draw.randint(1, 3)) for i in range(20_000)]
    counts = spark.createDataFrame(rows, "doc_id long, term string, tf long").groupBy("doc_id", "term").agg(F.sum("tf").alias("tf")).cache()
    for most, chunk in ((20, 1000), (50, 5000), (3000, 1000), (100_000, 1000)):  # the last two take all counts
        got, want = retrieval.frequent(counts, 20_000, most, chunk=chunk), retrieval.vocabulary(counts, 20_000, most)
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_dense_tasks_send_on_their_best_alone():
    """What a task sends on is at most k rows a query, ties included, over batches of any size; before, all ties of a pack were sent."""
    import pyarrow as pa

    rng = np.random.default_rng(2)
    v = rng.normal(size=(900, 8))
    v[300:700] = v[300]  # copies
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    ids = np.arange(0, 900, 50)
    batches = [pa.record_batch({"doc_id": pa.array(np.arange(i, min(i + 70, 900))), "v": pa.array(v[i : i + 70].tolist())}) for i in range(0, 900, 70)]
    for k, at_once in ((5, 512), (20, 16), (100, 64)):
        got = pa.Table.from_batches(retrieval._best_of_vectors(ids, v[ids], k, 6, at_once)(iter(batches))).to_pydict()
        want = set()
        for q in ids:
            rows = sorted((-round(float(v[d] @ v[q]), 6), d) for d in range(900) if d != q)[:k]
            want |= {(int(q), int(d), -s) for s, d in rows if s < 0}
        assert set(zip(got["qid"], got["doc_id"], got["score"], strict=True)) == want and len(got["qid"]) == len(want)


def test_counts_of_common_terms_stay_where_they_are(spark):
    """With more terms than are sent to all tasks, counts of the rarer ones alone are shuffled; before, all were. Rows are the same."""
    draw = random.Random(6)
    docs = spark.createDataFrame([(f"D{i:04}", " ".join(f"w{int(draw.paretovariate(0.6))}" for _ in range(30))) for i in range(400)] + [("rare", "once upon"), ("empty", "")], "doc_id string, text string")
    asked = spark.createDataFrame([(i, f"w1 w2 w{i} w{i + 40} once") for i in range(30)], "qid long, text string")
    counts = retrieval.term_counts(docs, "doc_id", "text").cache()
    terms = retrieval.vocabulary(counts, 402).cache()
    common, every = retrieval.often(terms, 100)
    assert not every and 30 < terms.filter(common).count() <= 100 and retrieval.often(terms, 100_000)[1]
    shuffled = counts.join(terms.filter(~common), "term").count()
    assert 0 < shuffled < counts.count() / 2
    for how in ("inner", "left"):
        got, want = (retrieval.looked_up(counts, terms.select("term", "df", "idf"), few, how).select("doc_id", "term", "tf", "idf").collect() for few in (100, 100_000))
        assert sorted(map(tuple, got)) == sorted(map(tuple, want))
    whole = retrieval.indexed(docs, "doc_id", "text", block_docs=16)
    for few in (100, 1, 0):
        index = retrieval.indexed(docs, "doc_id", "text", block_docs=16, few=few)
        got, want = ({(r["doc_id"], r["term"]): round(r["w"], 9) for r in x.postings().collect()} for x in (index, whole))
        assert got == want and len(got) == counts.count()
        got, want = (sorted(map(tuple, retrieval.pruned_top_k(x.asked(asked, "qid", "text"), x, 5).collect())) for x in (index, whole))
        assert got == want


def test_most_frequent_terms_leave_texts_where_they_are(spark):
    """Rows of one id are one document; before, all texts were shuffled by document and every one's words sorted."""
    draw = random.Random(8)
    rows = [(i % 37 if i < 40 else i, " ".join(draw.choice(["ab", "cd", "ef", "gh", f"t{draw.randint(0, 60)}"]) for _ in range(draw.randint(0, 30)))) for i in range(80)] + [(99, None), (98, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    found = retrieval.most_frequent(docs, "doc_id", "text", 12)
    cf, held = Counter(), {}
    for d, text in rows:
        for w in (text or "").split():
            cf[w] += 1
            held.setdefault(w, set()).add(d)
    want = sorted(cf, key=lambda t: (-cf[t], t))[:12]
    assert {tuple(r) for r in found.collect()} == {(t, len(held[t]), cf[t]) for t in want}
    assert "text" not in " ".join(x for x in found._jdf.queryExecution().executedPlan().toString().splitlines() if "Exchange hashpartitioning" in x)


def test_texts_do_not_meet_by_supplier(spark, sf_dir):
    """All documents have a few suppliers; before, a larger table of suppliers dealt all texts to as many tasks."""
    least = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = registry.studies(spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", least)
    assert "hashpartitioning(supplier" not in plan
