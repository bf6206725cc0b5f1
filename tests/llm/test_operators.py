"""The corpus operators on small tables with nulls, ties, empty and long texts, clashing columns."""

import collections
import hashlib
import itertools
import math
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from kifulake.llm import bagminhash, brown_lm, chat_format, decontaminate, graph, line_dedup, packing, quality_rules, record_files, token_counts, url_filter
from kifulake.llm.common import numbered, saved, scratch

BYTE, WORD = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")
#: Beside the table's own columns some that the operators might use themselves.
DOCS = "doc_id long, text string, lang string, uid long, n_chars long, block int, f int, r int, whole int, gone int, c0 int, _text int, _hits int, cluster int"
EXTRA = (0,) * 8


def sentences(rng, n):
    return " ".join(rng.choice("the of and to in that is was he for it with as his on be at by".split()) + rng.choice(["", "", "s", "ing", "ed", "x", "y"]) for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(7)
    texts = [sentences(rng, rng.randrange(5, 160)) + "\n" + sentences(rng, 12) for _ in range(40)]
    near = texts[0].split()
    near[3] = "other"
    line = "this is one line of boilerplate that many of the documents share"
    texts += [" ".join(near), texts[1], texts[1], "", " \n ", "a", "word " * 3000, line + "\nfirst body of text", line.replace("one", "0ne") + "\nsecond body of text", line + "\nfirst body of text", "# $ % & " * 60, "中文 é\n" * 20]
    out = [(i, t, "en", 1, len(t), 0, *EXTRA) for i, t in enumerate(texts)]
    return out + [(3, texts[3], "en", 1, 1, 0, *EXTRA), (None, "no id here but a text of some words", "en", 1, 1, 0, *EXTRA), (500, None, None, None, None, None, *EXTRA)]


@pytest.fixture(scope="module")
def docs(spark, rows, tmp_path_factory):
    to = str(tmp_path_factory.mktemp("docs") / "documents.parquet")
    spark.createDataFrame(rows, DOCS).repartition(3).write.parquet(to)
    return spark.read.parquet(to)


@pytest.fixture(scope="module")
def none(spark, tmp_path_factory):
    to = str(tmp_path_factory.mktemp("none") / "documents.parquet")
    spark.createDataFrame([], DOCS).write.parquet(to)
    return spark.read.parquet(to)


def ids_of(path, rows, end=2):
    library = Tokenizer.from_file(path)
    return [x.ids + [end] for x in library.encode_batch([r[1] or "" for r in rows], add_special_tokens=False)]


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def edits_between(a, b):
    prev = list(range(len(b) + 1))
    for i, c in enumerate(a, 1):
        cur = [i]
        for j, d in enumerate(b, 1):
            cur.append(min(prev[j - 1] + (c != d), prev[j] + 1, cur[-1] + 1))
        prev = cur
    return prev[-1]


def test_components(spark):
    rng = random.Random(2)
    edges = [(rng.randrange(80), rng.randrange(80)) for _ in range(60)] + [(1, 1), (None, 3)] + [(100, i) for i in range(101, 140)]
    root = {}
    top = lambda x: x if root.setdefault(x, x) == x else top(root[x])
    for a, b in edges:
        if a is not None and a != b:
            x, y = top(a), top(b)
            root[max(x, y)] = min(x, y)
    got = {r.node: r.root for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: top(x) for x in root}
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0


@pytest.mark.parametrize("held", [3, 40, 300])
def test_components_of_chains_and_stars(spark, held):
    """Whether all edges, some or nearly none meet in a task."""
    rng = random.Random(held)
    names = rng.sample(range(10_000), 200)
    edges = [(x, y) for x, y in zip(names[:60], names[1:61], strict=True)] + [(names[70], x) for x in names[71:130]] + [(rng.choice(names[130:]), rng.choice(names[130:])) for _ in range(50)]
    root = {}
    top = lambda x: x if root.setdefault(x, x) == x else top(root[x])
    for a, b in edges:
        if a != b:
            x, y = top(a), top(b)
            root[max(x, y)] = min(x, y)
    rows = [*edges, *edges[::3]]
    got = graph.components(spark.createDataFrame(rows, "a long, b long").repartition(5), held=held).collect()
    assert {r.node: r.root for r in got} == {x: top(x) for x in root} and len(got) == len(root)


def test_components_of_few_edges_take_no_rounds(spark, monkeypatch):
    """A round is some six shuffles; on many partitions a near-duplicate job was mostly these."""
    tables = []
    monkeypatch.setattr(graph, "saved", lambda df, what: tables.append(what) or saved(df, what))
    chain = spark.range(2000).selectExpr("id * 7919 % 2003 a", "(id + 1) * 7919 % 2003 b").repartition(8)
    got = graph.components(chain)
    assert got.select("root").distinct().count() == 1 and got.count() == 2001
    assert len(tables) == 2


def test_line_dedup(spark, docs, rows, none):
    order = sorted(range(len(rows)), key=lambda i: (rows[i][0] is None, rows[i][0] or 0))
    lines = [(i, n, x) for i in order for n, x in enumerate((rows[i][1] or "").split("\n")) if x.strip()]
    first = {}
    for i, n, x in lines:
        first.setdefault(x, len(first))
    texts = list(first)

    budget = lambda a, b: min(2, min(len(a), len(b)) // 16)
    linked = collections.defaultdict(set)
    for a in texts:
        for b in texts:
            if a < b and abs(len(a) - len(b)) <= budget(a, b) and edits_between(a, b) <= budget(a, b):
                linked[a].add(b)
                linked[b].add(a)
    got = collections.Counter((r.doc_id, r.n_lines, r.n_copies + r.n_near, r.n_links, len(r.removed)) for r in line_dedup.line_report(docs).collect())
    # repeated rows are told apart by place alone, so compare totals for each id
    want_links = collections.Counter()
    for i, _, x in lines:
        want_links[rows[i][0]] += len(linked[x])
    gone = len(lines) - sum(not any(first[y] < first[x] for y in linked[x]) for x in texts)
    assert sum(k[2] * v for k, v in got.items()) == gone == sum(k[4] * v for k, v in got.items())
    have = collections.Counter()
    for k, v in got.items():
        have[k[0]] += k[3] * v
    assert +have == +want_links and sum(want_links.values()) > 0
    left = line_dedup.without_repeats(docs)
    assert left.columns == docs.columns
    text = "\n".join(r.text or "" for r in left.collect())
    assert text.count("boilerplate") == 1
    assert line_dedup.line_report(none).count() == 0 and line_dedup.without_repeats(none).count() == 0


def test_line_report_names_the_pairs(spark, tmp_path):
    line = "this is one line of boilerplate that many documents share"
    rows = [(1, line + "\nown text"), (2, "x\n" + line), (3, line.replace("one", "0ne")), (4, line.replace("one", "onee")), (5, None)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "d.parquet"))
    got = {r.doc_id: [(m.n, tuple(m.first), None if m.others is None else [tuple(o) for o in m.others]) for m in r.members] for r in line_dedup.line_report(spark.read.parquet(str(tmp_path / "d.parquet"))).collect()}
    assert got == {1: [(0, (1, 0), [(3, 0), (4, 0)])], 2: [(1, (1, 0), None)], 3: [(0, (3, 0), [(1, 0), (4, 0)])], 4: [(0, (4, 0), [(1, 0), (3, 0)])], 5: []}


def edited(rng, text, most, alphabet):
    out = list(text)
    for _ in range(rng.randrange(most + 1)):
        at = rng.randrange(len(out) + 1)
        out[at : at + rng.randrange(2)] = rng.choice(["", *alphabet])
    return "".join(out)


@pytest.mark.parametrize("most", [1, 2, 3])
def test_banded_distance(spark, most):
    rng = random.Random(most)
    alphabet = "ab\u00e9\U0001d54f"
    pairs = []
    while len(pairs) < 600:
        a = "".join(rng.choice(alphabet) for _ in range(rng.randrange(1, 40)))
        b = edited(rng, a, 5, alphabet)
        if b and abs(len(a) - len(b)) <= most:
            pairs.append((a, b))
    got = spark.createDataFrame(pairs, "a string, b string").select("a", "b", line_dedup.distance(F.col("a"), F.col("b"), most).alias("d")).collect()
    assert [min(r.d, most + 1) for r in got] == [min(edits_between(r.a, r.b), most + 1) for r in got]


def test_near_lines_of_all_lengths(spark, tmp_path):
    # every pair within the budget is linked, whatever the lengths on either side of its steps
    rng, lines = random.Random(11), []
    for size in (*range(12, 40), 60, 200):
        a = "".join(rng.choice("abcdefgh ") for _ in range(size)).replace(" ", "x", 1)
        lines += [a, *(edited(rng, a, 3, "abz") for _ in range(4))]
    lines = [x for x in dict.fromkeys(lines) if x.strip()]
    spark.createDataFrame([(i, x) for i, x in enumerate(lines)], "doc_id long, text string").repartition(3).write.parquet(str(tmp_path / "d.parquet"))
    got = {r.doc_id: sorted(o.doc_id for m in r.members for o in m.others or ()) for r in line_dedup.line_report(spark.read.parquet(str(tmp_path / "d.parquet"))).collect()}
    close = lambda a, b: abs(len(a) - len(b)) <= (k := min(2, min(len(a), len(b)) // 16)) and edits_between(a, b) <= k
    assert got == {i: [j for j, b in enumerate(lines) if i != j and close(a, b)] for i, a in enumerate(lines)}
    assert sum(map(len, got.values())) > 100


def test_rows_keep_their_names_however_files_are_split(spark, tmp_path):
    to = str(tmp_path / "d.parquet")
    text = "a line of words that many of the rows share, long enough to be near another"
    spark.range(3000).selectExpr("id div 2 as doc_id", f"concat('{text}', cast(id div 3 as string), '\n', cast(id as string), ' ', repeat('{text} ', 8)) as text").repartition(2).write.option("parquet.block.size", 1 << 15).parquet(to)
    seen, before = set(), spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        for size in ("32k", "128m"):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            rows = numbered(spark.read.parquet(to))[0]
            seen.add((size, rows.rdd.getNumPartitions() > 4, rows.agg(F.sum(F.xxhash64("f", "r", "c0", "c1").cast("decimal(38,0)")), F.countDistinct("f", "r")).first()))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert {x[1] for x in seen} == {True, False} and len({x[2] for x in seen}) == 1 and next(iter(seen))[2][1] == 3000
    joined = spark.read.parquet(to).join(spark.range(5), F.col("id") == F.col("doc_id"))  # not a scan: saved first
    assert numbered(joined)[0].select("f", "r").distinct().count() == 10


def test_quality_rules(spark, docs, rows, none):
    labels = spark.createDataFrame([(r[0], int("#" not in (r[1] or "")), 0) for r in rows if r[0] is not None] + [(None, 1, 0), (2, None, 0)], "doc_id long, quality int, toxic int")
    judged = quality_rules.assess(docs, quality_rules.learn(docs, labels))
    assert judged.count() == len(rows)
    by = {r.doc_id: r for r in judged.collect()}
    assert by[500].n_words == 0 and by[500].base_failed and not by[500].kept
    plain = quality_rules.assess(docs, quality_rules.learn(docs, labels.where("quality = 1")))
    assert all(r.kept == (not r.base_failed) and r.score is None for r in plain.collect())
    assert quality_rules.assess(none, None).count() == 0


def test_near_classes(spark, docs, rows, none):
    bag = lambda t: collections.Counter(zip(*[t.split()[k:] for k in range(5)])) if len(t.split()) >= 5 else collections.Counter([tuple(t.split())] if t.split() else [])
    texts = [r[1] or "" for r in rows]
    bags, root = [bag(t) for t in texts], list(range(len(rows)))
    top = lambda x: x if root[x] == x else top(root[x])
    for i in range(len(rows)):
        for j in range(i):
            union = sum((bags[i] | bags[j]).values())
            if texts[i] == texts[j] or (union and sum((bags[i] & bags[j]).values()) >= 0.8 * union - 1e-9):
                root[max(top(i), top(j))] = min(top(i), top(j))
    want = sorted(collections.Counter(top(i) for i in range(len(rows))).values())
    for sizes in ({}, {"block": 2, "few": 1}):
        got = bagminhash.near_classes(docs, **sizes).collect()
        assert len(got) == len(rows) and sum(r.keep for r in got) == len(want)
        assert sorted(r.class_size for r in got if r.keep) == want
    kept = bagminhash.one_of_each(docs)
    assert kept.columns == docs.columns and kept.count() == len(want)
    assert bagminhash.near_classes(none).count() == 0 and bagminhash.one_of_each(none).count() == 0


def number(word):
    return int(brown_lm.tokens(pa.array([word]))[0][0]) if word != "\n" else brown_lm.END


def test_weak_chains_meet_in_small_stars(spark, tmp_path, monkeypatch):
    # each document shares some 0.6 with the next one; what is compared must grow with their number
    compared = {}
    links = bagminhash._links

    def counting(members, pairs, least):
        n = members.groupBy("cluster", "block").count().toPandas()
        compared["pairs"] += int((n["count"] * (n["count"] - 1) // 2).sum())
        return links(members, pairs, least)

    monkeypatch.setattr(bagminhash, "_links", counting)
    rng, per = random.Random(1), {}
    words = [f"{rng.randrange(10**6)}" for _ in range(20000)]
    for n in (60, 240):
        compared["pairs"], to = 0, str(tmp_path / f"{n}.parquet")
        spark.createDataFrame([(i, " ".join(words[25 * i : 25 * i + 100])) for i in range(n)], "doc_id long, text string").write.parquet(to)
        assert bagminhash.near_classes(spark.read.parquet(to)).where("class_size > 1").count() == 0
        per[n] = compared["pairs"] / n
    assert 0 < per[240] < 2 * per[60] + 1


def test_brown_scores(spark, docs, rows, none):
    low = str.maketrans({chr(65 + i): chr(97 + i) for i in range(26)})
    tokens = [re.findall(r"[^\x20\x09-\x0D]+", (r[1] or "").translate(low)) + ["\n"] for r in rows]
    out = [r[0] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 2 for r in rows]
    counts = collections.Counter(w for t, h in zip(tokens, out, strict=True) if not h for w in t)
    n, v = sum(counts.values()), len(counts)
    want = sorted((r[0] if r[0] is not None else -1, h, len(t), sum(w in counts for w in t), n, round(sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in t), 6)) for r, t, h in zip(rows, tokens, out, strict=True))
    model, table = brown_lm.learn(docs, ~brown_lm.held_out(F.col("doc_id")), hot=60, core=20, classes=6)
    got = brown_lm.score(docs, model, table).collect()
    assert sorted((r.doc_id if r.doc_id is not None else -1, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got) == want
    # the model's own score, from its tables
    of = {r.word: r.of for r in table.collect()}
    assert {r.word: r.c for r in table.where("c > 0").collect()} == {number(w): c for w, c in counts.items()}
    cls = lambda w: of.get(number(w), model.k - 1)
    assert all(cls(w) == model.k - 1 for w, c in counts.items() if c < 2 and w != "\n")
    scores = collections.Counter()
    for r, t in zip(rows, tokens, strict=True):
        total, last = 0.0, cls("\n")
        for w in t:
            total += model.moves[last, cls(w)] + math.log10((counts[w] + 1) / (model.sizes[cls(w)] + model.kinds[cls(w)] + 1))
            last = cls(w)
        scores[r[0], round(total, 5)] += 1
    assert collections.Counter((r.doc_id, round(r.score, 5)) for r in got) == scores
    assert all(r.perplexity == pytest.approx(10 ** (-r.score / r.n_tokens)) for r in got)
    pairs = collections.Counter((cls(a), cls(b)) for t, h in zip(tokens, out, strict=True) if not h for a, b in zip(["\n", *t], t))
    share = (model.sizes + 1) / (model.sizes.sum() + model.k)
    for a in range(model.k):
        row = sum(pairs[a, b] for b in range(model.k))
        assert model.moves[a] == pytest.approx([math.log10((pairs[a, b] + 2 * share[b]) / (row + 2)) for b in range(model.k)])
    assert brown_lm.score(none, *brown_lm.learn(none)).count() == 0
    nothing = brown_lm.score(docs, *brown_lm.learn(none)).collect()
    assert len(nothing) == len(rows) and all(r.n_known == 0 for r in nothing)


def test_class_scores_are_probabilities(spark, docs):
    model, table = brown_lm.learn(docs, hot=80, core=20, classes=5)
    assert np.allclose((10.0 ** model.moves).sum(axis=1), 1)
    emitted = collections.Counter()
    for r in table.collect():
        emitted[r.of] += (r.c + 1) / (model.sizes[r.of] + model.kinds[r.of] + 1)
    for of, p in emitted.items():  # what is left is for an unknown token
        assert p + 1 / (model.sizes[of] + model.kinds[of] + 1) == pytest.approx(1)


def test_what_is_broadcast_does_not_change_the_model(spark, tmp_path):
    # tokens of two kinds end alike; what stands beside them tells the kinds apart
    to = str(tmp_path / "documents.parquet")
    texts = [f"the {x}{i}q runs the big{i % 3} {x}{i}q runs" if x == "n" else f"we {x}{i}q it we can{i % 3} {x}{i}q it" for i in range(60) for x in "nv"]
    texts += ["held out " + "common " * 50] * 5
    spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(3).write.parquet(to)
    docs = spark.read.parquet(to)
    of = {}
    for hot in (12, 40, 1000):
        model, table = brown_lm.learn(docs, F.col("doc_id") < 120, hot=hot, core=11, classes=11)
        assert model.complete == (hot == 1000)
        of[hot] = sorted((r.word, r.c, r.of) for r in table.collect()), sorted((r.doc_id, r.n_known, round(r.score, 6), round(r.base_score, 6)) for r in brown_lm.score(docs, model, table).collect())
    assert of[12] == of[40] == of[1000]
    classes = {w: c for w, _, c in of[12][0]}
    nouns, verbs = ({classes[number(f"{x}{i}q")] for i in range(60)} for x in "nv")
    assert len(nouns) == len(verbs) == 1 and nouns != verbs


def test_chat(spark):
    odd = ["\\### Assistant: </turn> ok", "", None, "a\\", "<\\/turn>", "###", "x\ny: </", "\\\\#"]
    talk = [(1, i, ["system", "user", "assistant"][i % 3], t) for i, t in enumerate(odd)] + [(2, 0, "user", "only a question")] + [(None, 0, "ass:ist#ant", "z"), (3, None, None, "q"), (3, 1, "assistant", "r"), (3, 1, "assistant", "r")]
    df = spark.createDataFrame(talk, "conv_id long, turn long, role string, text string").withColumn("pos", F.lit(9))
    got = {r.conv_id: r for r in chat_format.digest(df).collect()}
    for key in (1, 2, 3, None):
        turns = sorted(((t if t is not None else -1, r or "", x or "") for c, t, r, x in talk if c == key))
        whole = "".join(f"{r}\n{x}\n" for _, r, x in turns)
        loss = "".join(x for _, r, x in turns if r == "assistant")
        assert (got[key].n_turns, got[key].turns_sha256, got[key].loss_chars, got[key].loss_sha256) == (len(turns), hashlib.sha256(whole.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
    examples = chat_format.rendered(chat_format.format_turns(df)).where("conv_id = 3").orderBy("example").collect()
    assert [(e.prompt, e.target) for e in examples] == [("### : q</turn>\n### assistant: ", "r"), ("### : q</turn>\n### assistant: r</turn>\n### assistant: ", "r")]
    assert chat_format.digest(df.where("false")).count() == 0


def test_chat_digest_reads_the_examples(spark, monkeypatch):
    talk = [(1, i, ["user", "assistant"][i % 2], f"t{i}") for i in range(6)] + [(None, 0, "assistant", "alone")]
    df = spark.createDataFrame(talk, "conv_id long, turn long, role string, text string")
    seen = lambda: {r.conv_id: (r.n_examples, r.context_chars, r.loss_chars) for r in chat_format.digest(df).collect()}
    prompts = chat_format.rendered(chat_format.format_turns(df)).where("conv_id = 1").collect()
    right = {1: (3, sum(len(p.prompt) for p in prompts), 6), None: (1, len("### assistant: "), 5)}
    assert seen() == right
    expand = chat_format.expand_targets
    monkeypatch.setattr(chat_format, "expand_targets", lambda t: expand(t).where("example <> 2"))
    assert seen()[1] == (2, right[1][1] - len(sorted(prompts, key=lambda p: p.example)[1].prompt), 4)
    monkeypatch.setattr(chat_format, "expand_targets", lambda t: expand(t).withColumn("context_chars", F.col("context_chars") - 1))
    assert seen() == {1: (0, 0, 0), None: (0, 0, 0)}


def test_url_aliases_of_all_forms(spark):
    refresh = lambda c: f"<meta http-equiv=refresh content={c}>"
    pages = [
        ("http://a.org/1", refresh('"0; url=\'https://x.org/p\'"')), ("http://a.org/2", refresh("'0;URL=\"https://x.org/p\"'")), ("http://a.org/3", refresh('"0; url=&#39;https://x.org/p&#x27;"')),
        ("http://a.org/d/e/f", '<link rel=canonical href="../g?x=1&amp;y=&amp;lt;2"><link href="/../h/./i/.." rel="canonical">' + refresh('"1;url=/first"') + refresh('"1;url=/second"')), ("http://a.org/k", None), ("http://a.org/l", "<p>url=/no"),
    ]
    got = {(r.a, r.b) for r in url_filter.alias_edges(spark.createDataFrame(pages, "url string, html string")).collect()}
    want = {(f"a.org/{i}", "x.org/p") for i in (1, 2, 3)} | {("a.org/d/e/f", b) for b in ("a.org/d/g?x=1&y=&lt;2", "a.org/h/", "a.org/first", "a.org/second")}
    assert got == want


def test_url_filter(spark):
    link = lambda u: f'<html><link rel="canonical" href="{u}"></html>'
    pages = [
        (1, "http://EXAMPLE.com/en/a?x#y", ""), (2, "http://www.example.com/en/", ""), (3, "http://a.net/es/1", ""), (4, "http://x.org/p", link("http://a.net/es/1")),
        (5, "http://y.org/q", '<meta http-equiv="refresh" content="0; url=//x.org/p">'), (6, "http://z.org/", link("/other")), (7, None, None), (8, "no scheme", None),
        (9, "http://w.org/", link("http://b.com/ok")), (10, "http://v.org/", link("http://x.org/p")), (10, "http://v.org/", None), (11, "http://com/", ""), (12, "http://notexample.com/en/", ""), (13, "http://u.org/1", link("http://w.org/")), (14, "http://u.org/1#f", None), (15, "http://w.org/?q", link("http://a.net/es/1"))]
    rules = [url_filter.Rule(*r) for r in (("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"))]
    got = url_filter.judge(spark.createDataFrame(pages, "page_id long, url string, html string"), rules).collect()
    assert len(got) == len(pages)
    said = collections.defaultdict(set)
    for r in got:
        said[r.page_id].add((r.rule, r.verdict))
    assert said[1] == {("example.com/en/", "block")} and said[2] == {("www.example.com/en/", "allow")} and said[3] == {("net/es/", "block")}
    assert said[4] == said[5] == said[10] == {(None, "block")}  # aliases of a blocked page
    assert said[9] == said[13] == said[14] == {(None, "allow")}  # an alias that a rule allows comes first
    assert said[6] == said[7] == said[8] == {(None, "allow")} and said[15] == {(None, "block")}
    assert said[11] == {("com/", "allow")} and said[12] == {("com/", "allow")}
    first = next(r for r in got if r.page_id == 1)
    assert (first.host, first.path) == ("example.com", "/en/a")
    assert url_filter.judge(spark.createDataFrame([], "page_id long, url string, html string"), rules).count() == 0


def test_url_verdicts_against_brute_force(spark):
    rng = random.Random(5)
    hosts = ["a.org", "www.a.org", "m.a.org", "b.net", "m.b.net", "c.com", "d.org", "www.com"]
    make = lambda: f"{rng.choice(['http', 'HTTPS'])}://{rng.choice(hosts)}{rng.choice(['', '/', '/es/', '/es/1', '/fr', f'/{rng.randrange(40)}/'])}{rng.choice(['', '?ref=1', '?utm_source=a&p=2', '?p=2&ref', '#t'])}"
    pages = [(i, make(), rng.choice([None, "<p>", "", "", "", f'<link rel="canonical" href="{make()}">', f'<meta http-equiv="refresh" content="1;url={make()}">'])) for i in range(120)]
    pages += [(200 + i, f"http://e{i}.org/p", '<link rel="canonical" href="http://b.net/es/zz">') for i in range(5)]
    rules = [url_filter.Rule("allow", "com", "/"), url_filter.Rule("block", "net", "/es/"), url_filter.Rule("allow", "m.b.net", "/es/"), url_filter.Rule("block", "d.org", "/")]

    def vertex(url):
        host, path, query = re.match(r"(?s)^.*?://([^/?#]*)([^?#]*)(\?[^#]*)?", url).groups()
        return host.lower() + path + (query or "")

    def plain(v):
        host, path, query = re.match(r"([^/?]*)([^?]*)(?:\?(.*))?$", v).groups()
        parts = host.split(".")
        host = ".".join(parts[1:]) if parts[0] in ("www", "m") and len(parts) > 2 else host
        kept = [x for x in (query or "").split("&") if x.split("=")[0] not in ("ref", "fbclid", "gclid") and not x.startswith("utm_")] if query else []
        return host + path.rstrip("/") + ("?" + "&".join(kept) if kept else "")

    def rule(v):
        host, path = re.match(r"([^/?]*)([^?]*)", v).groups()
        fits = [r for r in rules if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
        return max(fits, key=lambda r: (len(r.host + r.path), r.verdict == "allow"), default=None)

    root = {}
    top = lambda x: x if root.setdefault(x, x) == x else top(root[x])
    for _, url, html in pages:
        ends = [vertex(url)] + ([vertex(re.search(r'(?:href="|url=)([^"]+)', html)[1])] if html and html != "<p>" else [])
        for v in ends:
            root[top(v)] = top(plain(v))
            root[top(ends[0])] = top(v)
    said = collections.defaultdict(set)
    for v in list(root):
        if rule(v):
            said[top(v)].add(rule(v).verdict)
    want = {}
    for i, url, _ in pages:
        own = rule(vertex(url))
        want[i] = (own.host + own.path, own.verdict) if own else (None, "block" if said[top(vertex(url))] == {"block"} else "allow")
    got = {r.page_id: (r.rule, r.verdict) for r in url_filter.judge(spark.createDataFrame(pages, "page_id long, url string, html string"), rules).collect()}
    assert got == want and sum(x == (None, "block") for x in want.values()) > 3


def test_record_files(spark, docs, rows, none):
    to = scratch(spark, "test")
    record_files.write_records(docs, to, WORD, 2)
    got = sorted(record_files.read_index(spark, to).collect(), key=lambda r: r.start)
    assert [r.doc_id if r.doc_id is not None else -1 for r in got] == sorted(r[0] if r[0] is not None else -1 for r in rows)
    assert [r.start for r in got] == np.cumsum([0] + [r.n_tokens for r in got])[:-1].tolist()
    assert sorted(r.ids_crc32 for r in got) == sorted(map(crc, ids_of(WORD, rows)))
    made = spark.createDataFrame([(2, "b"), (1, "a")], "doc_id long, text string")  # no file statistics
    beside = scratch(spark, "test")
    record_files.write_records(made, beside, WORD, 2)
    assert [r.doc_id for r in record_files.read_index(spark, beside).orderBy("start").collect()] == [1, 2]
    empty = scratch(spark, "test")
    record_files.write_records(none, empty, WORD, 2)
    assert record_files.read_index(spark, empty).count() == 0


def test_decontamination(spark, docs, rows, none):
    item = " ".join(rows[0][1].split()[:30])
    bench = spark.createDataFrame([(1, item.upper() + "x"), (2, None), (3, " "), (4, item), (None, "the")], "item_id long, text string")
    finder = decontaminate.Finder([(1, decontaminate.plain(item.upper() + "x")), (4, decontaminate.plain(item))])
    want = sorted((r[0] if r[0] is not None else -1, sorted(i for i, _ in finder.found(r[1] or ""))) for r in rows)
    for most in (1_000_000, 10):
        got = decontaminate.matches(docs, bench, most=most).collect()
        assert sorted((r.doc_id if r.doc_id is not None else -1, sorted(h.item_id for h in r.hits)) for r in got) == want
    assert decontaminate.clean(docs, bench).count() == sum(not w for _, w in want) < len(rows)
    assert decontaminate.clean(docs, bench).columns == docs.columns
    assert decontaminate.matches(none, bench).count() == 0 and decontaminate.clean(docs, bench.limit(0)).count() == len(rows)


def test_packing(spark, docs, rows, none):
    ids = ids_of(BYTE, rows)
    for deal in (50_000, 8):
        got = packing.pack(docs, BYTE, 2, size=128, deal=deal).collect()
        assert sum(r.length for r in got) == sum(map(len, ids))
        filled = collections.defaultdict(list)
        for r in got:
            filled[r.sequence_id].append((r.offset, r.length))
        for parts in filled.values():
            parts.sort()
            assert [a for a, _ in parts] == np.cumsum([0] + [n for _, n in parts])[:-1].tolist() and sum(n for _, n in parts) <= 128
        have = collections.Counter(r.ids_crc32 for r in got)
        assert have == collections.Counter(crc(x[a : a + n]) for x in ids for a, n in packing.cuts(len(x), 128))
        if deal > len(got):
            assert len(filled) <= packing.lower_bound(np.array([n for x in ids for _, n in packing.cuts(len(x), 128)]), 128) + 1
        # the certificate: as many sequences as the rows say, and no fewer than the bound over their pieces
        for (bins, bound), group in itertools.groupby(sorted(got, key=lambda r: (r.bins, r.bound)), key=lambda r: (r.bins, r.bound)):
            group = list(group)
            assert bins >= bound and all(r.certified == (bins == bound) for r in group)
            if bins > 1 and deal > len(got):
                assert len({r.sequence_id for r in group}) == bins and bound == packing.lower_bound(np.array([r.length for r in group]), 128)
    named = packing.pack(docs.withColumn("doc_id", F.concat(F.lit("d"), "doc_id")), BYTE, 2, size=128)
    assert named.schema["doc_id"].dataType.simpleString() == "string" and named.count() == len(got)
    assert packing.pack(none, BYTE, 2).count() == 0


def test_token_counts(spark, docs, rows, none):
    want = sorted((r[0] if r[0] is not None else -1, len((r[1] or "").encode()), len(x) - 1, len(x) - 1 > 50) for r, x in zip(rows, ids_of(BYTE, rows), strict=True))
    for hot in (20_000, 5):
        got = token_counts.count_tokens(docs, BYTE, limit=50, hot=hot).collect()
        assert sorted((r.doc_id if r.doc_id is not None else -1, r.n_bytes, r.n_tokens, r.over_limit) for r in got) == want
    assert len(token_counts.frequent_pieces(docs, BYTE, 5)) <= 5
    assert token_counts.count_tokens(none, BYTE).count() == 0


def test_pipeline(spark, docs, rows, none, tmp_path):
    sf = str(tmp_path)
    docs.drop("uid", "block").withColumn("source", F.lit("s")).select("doc_id", "text", "lang", "source", "n_chars").write.parquet(f"{sf}/documents.parquet")
    spark.createDataFrame([(r[0], int("#" not in (r[1] or "")), 0) for r in rows if r[0] is not None], "doc_id long, quality int, toxic int").write.parquet(f"{sf}/labels.parquet")
    spark.createDataFrame([(1, " ".join(rows[5][1].split()[:8]))], "item_id long, text string").write.parquet(f"{sf}/benchmark.parquet")
    now, counts = spark.read.parquet(f"{sf}/documents.parquet"), []
    columns = now.columns
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        to = f"{sf}/{name}"
        stage(spark, now, sf).write.parquet(to)
        now = spark.read.parquet(to)
        counts.append(now.count())
        if k < 4:
            assert now.columns == columns
    assert len(rows) > counts[0] >= counts[1] >= counts[2] >= counts[3] > 0
    assert corpus_pipeline.run(spark, sf).count() == counts[-1]


def test_rows_that_go_to_a_worker_at_once(spark):
    from kifulake.llm import common

    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows], pa.int64())], ["n"])

    before = spark.conf.get(common.BATCH)
    got = common.saved(spark.range(100).coalesce(1).mapInArrow(sizes, "n long"), "sizes", rows=30)
    assert sorted(r.n for r in got.collect()) == [10, 30, 30, 30] and spark.conf.get(common.BATCH) == before


def test_marks_of_lines_within_edits_are_near(spark):
    """A mark reads a line 20 times at most, and an edit changes two of its bits at most."""
    assert len(set(line_dedup.MARKED)) == len(line_dedup.MARKED) <= 20
    pairs = [("the cat sat on 10 mats", "the cat sat on 11 mats"), ("eeeee and more of it", "eeee and more of it"), ("Größe, nation", "Größe nation"), ("a b", "c b")]
    m = spark.createDataFrame(pairs, "a string, b string").select(F.bit_count(line_dedup.mark(F.col("a")).bitwiseXOR(line_dedup.mark(F.col("b")))).alias("n"))
    assert max(r.n for r in m.collect()) <= 2
