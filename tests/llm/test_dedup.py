"""Exact duplicates, near copies and recurring lines against plain Python."""

import hashlib
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from repo_signals.llm import exact_dedup, line_templates, ngram_join
from repo_signals.llm.components import connected_components, with_more_links
from repo_signals.llm.exact_dedup import exact_dedup as dedup
from repo_signals.session import materialize

linked = ngram_join.linked
WORD = re.compile(r"[^\x20\x09-\x0D]+")
FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain_groups(rows):
    groups = defaultdict(list)
    for doc, text in rows:
        groups[(text or "").translate(FOLD)].append(doc)
    out = Counter()
    for text, ids in groups.items():
        known = [i for i in ids if i is not None]
        keep = max(known) if known else None
        sha = hashlib.sha256(text.encode()).hexdigest()
        order = sorted(ids, key=lambda i: (i is None, -(i or 0)))
        for place, doc in enumerate(order):
            out[doc, keep, len(ids), place == 0, sha] += 1
    return out


def test_exact_dedup(docs, rows):
    got = Counter((r.doc_id, r.keep_id, r.group_size, r.kept, r.text_sha256) for r in dedup(docs).collect())
    assert got == plain_groups(rows)


def test_exact_dedup_across_partitions(spark):
    """A text that fills many partitions is one group."""
    rows = [(k, "same text") for k in range(400)] + [(1000 + k, "other %d" % k) for k in range(50)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = Counter((r.doc_id, r.keep_id, r.group_size, r.kept, r.text_sha256) for r in dedup(df).collect())
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert got == plain_groups(rows)


def test_runs_of_one_partition():
    import pyarrow as pa

    batch = pa.RecordBatch.from_arrays([pa.array([3, 2, 1]), pa.array(["a", "a", "b"]), pa.array(["x", "x", "y"])], names=["i", "b", "d"])

    class Context:
        @staticmethod
        def get():
            return type("C", (), {"partitionId": staticmethod(lambda: 4)})

    old, exact_dedup.TaskContext = exact_dedup.TaskContext, Context
    try:
        out = [r for b in exact_dedup.find_runs(iter([batch])) for r in b.to_pylist()]
    finally:
        exact_dedup.TaskContext = old
    assert [(r["doc_id"], r["run"], r["run_size"], r["run_keep"], r["leads"]) for r in out] == [
        (3, 0, 2, 3, True),
        (2, 0, 2, 3, False),
        (1, 1, 1, 1, True),
    ]


def test_similar_pairs(docs, rows):
    """Every link between representatives is true, and the links with the memberships give the groups."""
    pairs, members = ngram_join.similar_pairs(docs)
    sets = defaultdict(list)
    for doc, text in rows:
        sets[doc].append(shingles(text))
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for r in pairs.collect():
        shared = [len(x & y) for x in sets[r.a] for y in sets[r.b]]
        assert r.n_both in shared and r.similarity >= 0.8 and r.a < r.b
        parent[find(max(find(r.a), find(r.b)))] = find(min(find(r.a), find(r.b)))
    found = members.collect()
    assert {r.doc_id for r in found} == {d for d, t in rows if d is not None and shingles(t)}
    assert all(find(r.representative) == r.component_id for r in found)


def near_copies(n, changed, seed):
    """Copies of one text of 300 words with so many words changed in each."""
    rng = np.random.default_rng(seed)
    base = ["w%d" % k for k in range(300)]
    out = []
    for k in range(n):
        words = list(base)
        for at in rng.choice(300, changed, replace=False):
            words[at] = "x%d_%d" % (k, at)
        out.append((k, " ".join(words)))
    return out


def test_pairs_tried_in_a_group_of_near_copies(spark, monkeypatch):
    """Copies with a few changes each: about one pair per copy is counted, whatever the number of copies."""
    tried = []
    monkeypatch.setattr(ngram_join, "linked", lambda held, pairs, *rest: (tried.append(pairs.count()), linked(held, pairs, *rest))[1])
    for n in (100, 200):
        rows = near_copies(n, 1, n) + [(1000 + k, t) for k, t in near_copies(n // 10, 3, n + 1)]
        df = spark.createDataFrame(rows, "doc_id long, text string")
        got = Counter((r.doc_id, r.n_shingles, r.component_id) for r in ngram_join.similar_documents(df).collect())
        assert got == plain_components(rows)
        assert sum(tried) < 4 * len(rows)
        tried.clear()


def shingles(text):
    words = WORD.findall((text or "").translate(FOLD))
    if len(words) >= 5:
        return {tuple(words[k : k + 5]) for k in range(len(words) - 4)}
    return {tuple(words)} if words else set()


def plain_components(rows):
    sets = [shingles(t) for _, t in rows]
    post = defaultdict(list)
    for k, s in enumerate(sets):
        for x in s:
            post[x].append(k)
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for k, s in enumerate(sets):
        both = Counter(j for x in s for j in post[x] if j < k)
        for j, n in both.items():
            if 100 * n >= 80 * (len(s) + len(sets[j]) - n):
                parent[find(k)] = find(j)
    members = defaultdict(list)
    for k in range(len(rows)):
        members[find(k)].append(k)
    out = Counter()
    for group in members.values():
        known = [rows[k][0] for k in group if rows[k][0] is not None]
        for k in group:
            out[rows[k][0], len(sets[k]), min(known) if known else None] += 1
    return out


def test_similar_documents(docs, rows):
    got = Counter((r.doc_id, r.n_shingles, r.component_id) for r in ngram_join.similar_documents(docs).collect())
    assert got == plain_components(rows)


def test_many_near_copies_and_a_common_passage(spark, monkeypatch):
    """Frequent n-grams, several fragments, small flushes: chains of copies and a passage that unrelated texts share."""
    monkeypatch.setattr(ngram_join, "FREQUENT", 2)
    rng = np.random.default_rng(3)
    base = [f"b{k}" for k in range(90)]
    passage = [f"p{k}" for k in range(46)]
    rows = []
    for k in range(120):
        text = list(base)
        for at in rng.choice(90, size=rng.integers(0, 4), replace=False):
            text[at] = f"x{k}_{at}"
        rows.append((1000 + k, " ".join(text)))
    for k in range(60):
        own = [f"o{k}_{j}" for j in range(int(rng.integers(0, 16)))]
        rows.append((5000 + k, " ".join(own + passage)))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = Counter((r.doc_id, r.n_shingles, r.component_id) for r in ngram_join.similar_documents(df).collect())
    assert got == plain_components(rows)


def test_links_without_identifiers(spark):
    words = [f"w{k}" for k in range(60)]
    texts = [" ".join(words), " ".join([*words[:58], "x", "y"]), " ".join(["z", *words[1:]])]
    rows = [(None, texts[0]), (None, texts[1]), (5, texts[2]), (None, "all by itself here now")]
    got = ngram_join.similar_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in got) == plain_components(rows)
    alone = ngram_join.similar_documents(spark.createDataFrame(rows[:2], "doc_id long, text string")).collect()
    assert [r.component_id for r in alone] == [None, None]


def test_one_of_each_group(docs, rows):
    kept = ngram_join.one_of_each_group(docs)
    assert kept.columns == docs.columns
    groups = defaultdict(set)
    for (doc, _, component), _n in plain_components(rows).items():
        groups[component].add(doc)
    got = Counter(r.doc_id for r in kept.collect())
    wanted = Counter({c: 1 for c in groups if c is not None})
    wanted[None] = 1
    assert got == wanted


def test_components(spark):
    links = [(k, k + 1) for k in range(0, 40)] + [(100, 90), (90, 95), (7, 7)] + [(500, 500 + k) for k in range(1, 60)]
    got = dict(connected_components(spark.createDataFrame(links, "a long, b long")).collect())
    assert got == {**{k: 0 for k in range(41)}, **{k: 90 for k in (90, 95, 100)}, **{500 + k: 500 for k in range(60)}}


def test_components_with_more_links(spark):
    """Links come in three lots; new nodes, links inside a component, and links that join several."""
    lots = [[(1, 2), (5, 6), (8, 9)], [(2, 1), (6, 9), (20, 21)], [(21, 5), (30, 31), (2, 40)]]
    components = None
    for lot in lots:
        components = with_more_links(components, spark.createDataFrame(lot, "a long, b long"))
    whole = connected_components(spark.createDataFrame([e for lot in lots for e in lot], "a long, b long"))
    assert dict(components.collect()) == dict(whole.collect()) and components.count() == whole.count()


def plain_lines(rows):
    """The report of line_templates in plain Python, with real words instead of hashes and sets of texts instead of sums."""
    texts = {t for _, t in rows if t is not None}

    def masked(line):
        return tuple("< >" if re.search(r"[0-9]", w) else w for w in WORD.findall(line))

    def limit(n):
        return 12 if n < 8 else max(2, 5 - (n - 8) // 14)

    support = defaultdict(set)
    for t in texts:
        for line in t.split("\n"):
            words = masked(line)
            if len(words) >= line_templates.MIN_WORDS:
                support[words].add(t)
    leaf = lambda w: (len(w), w[: line_templates.DEPTH])
    common = defaultdict(set)
    for words, docs in support.items():
        for place, word in enumerate(words):
            if word != "< >":
                common[leaf(words), place, word] |= docs
    template = {}
    for words in support:
        enough = min(5, limit(len(words)))
        fixed = tuple((p, w) for p, w in enumerate(words) if w != "< >" and len(common[leaf(words), p, w]) >= enough)
        if 100 * len(fixed) >= line_templates.MIN_FIXED_PERCENT * len(words):
            template[words] = (leaf(words), fixed)
    carriers = defaultdict(set)
    for words, t in template.items():
        carriers[t] |= support[words]
    first = lambda text: hashlib.md5(text.encode()).hexdigest()
    keeper = {t: min(docs, key=first) for t, docs in carriers.items()}
    recurring = {w: t for w, t in template.items() if len(carriers[t]) >= limit(len(w))}
    out = Counter()
    for doc, text in rows:
        if text is None:
            out[doc, 0, 0, None] += 1
            continue
        lines = text.split("\n")
        found = [recurring.get(masked(x)) for x in lines]
        kept = [x for x, t in zip(lines, found) if t is None or keeper[t] == text]
        out[doc, len(lines), len(lines) - len(kept), "\n".join(kept)] += 1
    return out


def test_line_report(docs, rows):
    got = Counter((r.doc_id, r.n_lines, r.n_dropped, r.text) for r in line_templates.line_report(docs).collect())
    assert got == plain_lines(rows)


def test_templates_with_variable_fields(spark):
    rows = []
    for k in range(40):
        own = " ".join(f"own{chr(97 + k // 26)}{chr(97 + k % 26)}{c}" for c in "abcdefghij" * 3)
        rows.append((k, f"{own}\nPage {k} of 40 printed by user name{chr(97 + k % 26)}x on the old machine\n{own} more"))
    rows.append((99, "Page of the book that I like to read at night when it rains\n" + "calm " * 40))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = Counter((r.doc_id, r.n_lines, r.n_dropped, r.text) for r in line_templates.line_report(df).collect())
    assert got == plain_lines(rows)
    # One of them keeps the line.
    assert sum(gone for _, _, gone, _ in got) == 39 and all(gone == 0 for doc, _, gone, _ in got if doc == 99)


def test_a_single_document_makes_no_template(spark):
    """Many different lines of one shape in one or a few documents are no recurrence; the same shape in enough documents is."""
    lines = [f"Take one cup of {w} and stir it slowly into the pan" for w in "rice milk salt corn oats flour sugar".split()]
    short = [f"Add the {w}" for w in "rice milk salt corn oats flour sugar beans peas eggs figs dates nuts kale".split()]
    rows = [(1, lines), (2, short), (3, lines[:3])]
    rows += [(10 + k, [f"Put one spoon of {w} on top of it before you serve"]) for k, w in enumerate("abcde")]
    # Five lines in four documents: the sum is five, the documents are not.
    rows += [(20 + k, [f"Cut one slice of {w} as thin as you can manage it"]) for k, w in enumerate("abcd")]
    rows[-1][1].append("Cut one slice of e as thin as you can manage it")
    own = lambda doc: " ".join(f"own{chr(97 + doc)}{chr(97 + k)}" for k in range(26)) + " calm" * (99 + doc)
    rows = [(doc, "\n".join([own(doc), *more])) for doc, more in rows]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = {r.doc_id: r.n_dropped for r in line_templates.line_report(df).collect()}
    assert sum(got.values()) == 4 and all(10 <= doc < 20 for doc, n in got.items() if n)


def test_passages_and_documents_of_boilerplate(spark):
    """A passage of 60 words in two different documents stays in one; documents that are mostly boilerplate lose it too."""
    word = lambda k: "".join(chr(97 + int(d)) for d in str(k + 1000))
    passage = " ".join(word(k) for k in range(60))
    notice = "this notice must stay with all copies of the work that you give away"
    rows = [(1, f"first own line here\n{passage}"), (2, f"{passage}\nsecond own line there"), (3, passage + " and more")]
    rows += [(10 + k, f"{notice}\nabout {word(500 + k)}") for k in range(8)]
    rows += [(20, notice), (21, "\n".join([passage[:150]] + [word(900 + k) for k in range(50)]))]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = Counter((r.doc_id, r.n_lines, r.n_dropped, r.text) for r in line_templates.line_report(df).collect())
    assert got == plain_lines(rows)
    lost = {doc: n for doc, _, n, _ in got}
    assert lost[1] + lost[2] == 1 and lost[3] == 0
    assert sum(lost[doc] for doc in [*range(10, 18), 20]) == 8


def test_line_columns_and_empty_tables(docs, nothing):
    assert line_templates.without_recurring_lines(docs).columns == docs.columns
    assert line_templates.line_report(nothing).collect() == []
    assert dedup(nothing).collect() == []
    assert ngram_join.similar_documents(nothing).collect() == []
    assert ngram_join.one_of_each_group(nothing).collect() == []


@pytest.mark.parametrize("n", [1, 2, 4, 5, 9, 10, 46, 100, 1000])
def test_prefixes_meet(n):
    """Two sets of the least similarity always share an n-gram of their prefixes."""
    for m in range(-(-80 * n // 100), n + 1):
        least = -(-80 * (n + m) // 180)
        assert ngram_join.prefix_length(n, 80) >= n - least + 1
        assert ngram_join.prefix_length(m, 80) >= m - least + 1


def test_a_text_is_shuffled_once(spark):
    """The join of the texts that lose lines moves each text in its row only."""
    docs = spark.createDataFrame([(1, "a b c"), (2, None)], "doc_id long, text string")
    plan = line_templates.cleaned(docs)._jdf.queryExecution().optimizedPlan()
    found, left = [plan], []
    while found:
        node = found.pop()
        children = [node.children().apply(k) for k in range(node.children().size())]
        if node.nodeName() == "Join":
            left.append(children[0].schema().simpleString())
        found += children
    assert left and all(columns.count("string") == 1 for columns in left)


def test_partners_are_those_within_reach():
    """Rows of an n-gram stay if another may be similar, and no reachable pair is lost."""
    rng = np.random.default_rng(5)
    ids = np.sort(rng.integers(0, 60, 400))
    n = rng.integers(1, 60, 400).astype(np.uint32)
    at = (rng.random(400) * (n * 0.2 + 1)).astype(np.uint32)
    left = set(ngram_join.with_partner(ids, n, at, 80).tolist())
    pairs = {
        (x, y)
        for x in range(400)
        for y in range(400)
        if x != y and ids[x] == ids[y] and 100 * min(n[x], n[y]) >= 80 * max(n[x], n[y])
        and 180 * min(int(n[x]) - int(at[x]), int(n[y]) - int(at[y])) >= 80 * (int(n[x]) + int(n[y]))
    }
    assert pairs and {x for x, _ in pairs} <= left and len(left) < 400
    assert len(ngram_join.with_partner(ids[:0], n[:0], at[:0], 80)) == 0
    assert len(ngram_join.with_partner(np.array([7, 7]), np.array([100, 10], np.uint32), np.zeros(2, np.uint32), 80)) == 0


def test_asked_only_is_exact(spark, monkeypatch):
    """A short list and a long one, which goes by a bitmap, keep the same rows."""
    rows = spark.range(4000).select(F.xxhash64("id").alias("at"), F.col("id").alias("entry"))
    wanted = materialize(rows.where("entry % 3 = 0").select("at"), "wanted")
    for most in (1 << 16, 10):
        monkeypatch.setattr(line_templates, "SENT_WHOLE", most)
        assert {r.entry for r in line_templates.asked_only(rows, wanted, "at").collect()} == set(range(0, 4000, 3))


def test_texts_are_read_twice_for_their_lines(spark, monkeypatch):
    """Once to count the entries, once for the lines of those that are busy enough; every read costs as much as the whole rest."""
    reads, keyed = [], line_templates.keyed
    monkeypatch.setattr(line_templates, "keyed", lambda docs: reads.append(1) or keyed(docs))
    line = "a notice of ten words that stands in every document"
    df = spark.createDataFrame([(k, f"text {chr(97 + k) * 4} is here\n{line}") for k in range(9)], "doc_id long, text string")
    kept = [r.text for r in line_templates.without_recurring_lines(df).collect()]
    assert len(kept) == 9 and sum(line in t for t in kept) == 1 and len(reads) == 2


def test_sketches_never_rule_out_a_link():
    """The bound holds for sets of any two sizes, and is close enough to end pairs that share a third."""
    rng = np.random.default_rng(11)
    for n, m, both in [(1, 1, 1), (1, 1, 0), (5, 4, 4), (40, 70, 40), (500, 500, 160), (900, 1100, 900), (3000, 9, 9), (513, 512, 480)]:
        grams = rng.integers(0, 1 << 63, n + m - both, np.uint64) << np.uint64(1)
        x, y = np.sort(grams[:n]), np.sort(grams[n - both :])
        assert len(np.intersect1d(x, y)) == both and len(y) == m
        most = ngram_join.most_shared(ngram_join.sketch(x), n, ngram_join.sketch(y), m)
        assert most == ngram_join.most_shared(ngram_join.sketch(y), m, ngram_join.sketch(x), n)
        assert both <= most <= min(n, m)
        assert both > 160 or n < 500 or m < 500 or 180 * most < 80 * (n + m)


def test_ngrams_meet_for_likely_pairs_only(spark):
    """Texts that share a passage are told apart by their sketches: their n-grams are not sent to meet."""
    passage = [f"p{k}" for k in range(60)]
    rows = [(k, " ".join([f"o{k}_{j}" for j in range(140)] + passage)) for k in range(8)]
    rows += [(100 + k, t) for k, t in near_copies(2, 2, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    nodes = {r.doc_id: r.node for r in ngram_join.fingerprints(docs, 5).collect()}
    held = ngram_join.segments(docs, ngram_join.fingerprints(docs, 5).selectExpr("node", "doc_id as doc"), 5)
    pairs = [(nodes[a], nodes[b]) for a in nodes for b in nodes if a < b]
    pairs = spark.createDataFrame(pairs, "a long, b long")
    left = {(r.a, r.b) for r in ngram_join.likely(pairs, ngram_join.sketches(held), 80).collect()}
    assert left == {(nodes[100], nodes[101])}
    found = ngram_join.linked(held, pairs, ngram_join.sketches(held), 80).collect()
    assert {(r.a, r.b) for r in found} == left


def test_rounds_and_components_read_few_tables(spark, monkeypatch):
    """A round reads its prefixes with their components once, and a graph that is stars is not contracted again."""
    from repo_signals.llm import components

    calls, written = [], []
    joined, write = ngram_join.with_component, components.materialize
    monkeypatch.setattr(ngram_join, "with_component", lambda rows, found: calls.append(1) or joined(rows, found))
    monkeypatch.setattr(components, "materialize", lambda df, name: written.append(name) or write(df, name))
    rounds, hubs = [], ngram_join.hub_pairs
    monkeypatch.setattr(ngram_join, "hub_pairs", lambda *a: rounds.append(1) or hubs(*a))
    df = spark.createDataFrame(near_copies(60, 1, 7), "doc_id long, text string")
    assert len({r.component_id for r in ngram_join.similar_documents(df).collect()}) == 1
    assert len(calls) <= len(rounds) + 2
    written.clear()
    star = spark.createDataFrame([(k, 1) for k in range(2, 30)], "a long, b long")
    assert set(connected_components(star).collect()) == {(k, 1) for k in range(1, 30)} and written == ["edges"]


def test_rounds_of_hubs_read_crowded_ngrams_only(spark, monkeypatch):
    """Pairs of texts that share a passage wait for the end, while the rounds join a large group of near copies."""
    rng = np.random.default_rng(4)
    base = [f"b{k}" for k in range(90)]
    rows = []
    for k in range(40):
        text = list(base)
        for at in rng.choice(90, size=rng.integers(0, 3), replace=False):
            text[at] = f"x{k}_{at}"
        rows.append((1000 + k, " ".join(text)))
    for k in range(60):
        passage, own = [f"p{k // 2}_{j}" for j in range(30)], [f"o{k}_{j}" for j in range(6)]
        rows.append((5000 + k, " ".join(own + passage)))
    read, hubs = [], ngram_join.hub_pairs

    def seen(mixed, *rest):
        sizes = mixed.groupBy("ngram").count().collect()
        read.append(min(r["count"] for r in sizes))
        return hubs(mixed, *rest)

    monkeypatch.setattr(ngram_join, "hub_pairs", seen)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = Counter((r.doc_id, r.n_shingles, r.component_id) for r in ngram_join.similar_documents(df).collect())
    assert got == plain_components(rows)
    assert read and min(read) > ngram_join.PAIRS_PER_ROW
