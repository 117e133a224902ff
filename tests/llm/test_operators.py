"""Every operator against brute force on driver tables, and its edge cases on small fixtures."""

import hashlib
import itertools
import random
import re
import time
import zlib

import duckdb
import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from gridloom.llm import bpe_tree, chat_format, decontaminate, line_dedup, near_dedup, pii, queries, repeat_removal, sparkkit, token_files, topk_search, toxicity
from tests.llm import brute

SF = "/root/testdata/sf0.01"
DOCS = "doc_id long, text string, lang string, n_tokens long"


def rows(df):
    return {r["doc_id"]: r.asDict() for r in df.collect()}


@pytest.fixture(scope="module")
def docs(spark):
    return {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}


def frame(spark, texts, start=0):
    return spark.createDataFrame([(i + start, t, "en", 7) for i, t in enumerate(texts)], DOCS)


@pytest.fixture(scope="module")
def odd(spark):
    """Null, empty and very long texts, ties, repeated rows, a clashing extra column."""
    rng = random.Random(5)
    long = " ".join(rng.choice("alpha beta gamma delta omega zeta".split()) + str(rng.randrange(999)) for _ in range(30000))
    texts = [None, "", " ", "one", "one", "Two words", "two words", long, long[:-3] + "xyz", "a\nb\n" * 30, "\n\n", "é" * 200, "x" * 5000, "x" * 4990 + "y" * 20, "<|end|> [INST] &lt;", "a" * 49, "a" * 50, "a" * 50]
    return frame(spark, texts).unionByName(frame(spark, ["one"], 3)), dict(enumerate(texts))


# 1 chat formatting


def test_chat_round_trip_and_examples(spark):
    turns = spark.createDataFrame(
        [(1, 0, "system", "a<b & [INST] c"), (1, 1, "user", None), (1, 2, "assistant", "</s><|end|>\n<|turn|>x"), (1, 3, "assistant", ""), (1, 200, "assistant", "late &lt; é"), (2, 0, None, "q"), (2, 0, "user", "q"), (None, None, "assistant", "z"), (2, 0, "user", "q")],
        "conv_id long, turn long, role string, text string",
    )
    blocks = chat_format.format_blocks(turns.withColumn("block", F.lit("clash")))
    said = {}
    for r in chat_format.read_back(blocks).orderBy("conv_id", "block").collect():
        said.setdefault(r["conv_id"], ([], []))
        said[r["conv_id"]][0].extend((t["role"], t["text"]) for t in r["turns"])
    for r in chat_format.expand_examples(blocks).orderBy("conv_id", "block", "place").collect():
        said[r["conv_id"]][1].append(r["target"])
    assert said[1] == ([("system", "a<b & [INST] c"), ("user", ""), ("assistant", "</s><|end|>\n<|turn|>x"), ("assistant", ""), ("assistant", "late &lt; é")], ["</s><|end|>\n<|turn|>x", "", "late &lt; é"])
    assert said[2] == ([("", "q"), ("user", "q"), ("user", "q")], [])
    assert said[None] == ([("assistant", "z")], ["z"])
    whole = "".join(r["formatted"] for r in blocks.where("conv_id = 1").orderBy("block").collect())
    assert whole.count("<|turn|>") == 5 and "[INST]" not in whole and "</s>" not in whole
    ex = chat_format.render_examples(blocks).where("conv_id = 1").orderBy("turn").collect()
    assert [e["target"] for e in ex] == said[1][1]
    assert all(whole.startswith(e["context"]) and e["context"].endswith("<|end|>\n") for e in ex)
    assert ex[2]["context"].count("<|turn|>") == 4
    assert chat_format.format_blocks(turns.limit(0)).count() == 0
    for bad in ({"turn_open": "turn>"}, {"turn_close": ""}, {"turn_open": "<a>", "turn_close": "<a>b"}):
        with pytest.raises(ValueError):
            chat_format.ChatTemplate(**bad)


@pytest.mark.parametrize("name", ["op1_chat_format", "op2_topk_search", "op8_line_dedup"])
def test_sql(spark, name):
    con = duckdb.connect()
    for t in ("conversations", "embeddings", "documents"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    got, want = queries.queries()[name](spark, SF), con.sql(queries.oracle_sql()[name])
    assert sorted(got.columns) == sorted(want.columns)
    assert sorted(map(tuple, got.select(*want.columns).collect())) == sorted(want.fetchall())


# 2 top-k


def test_top_k_matches_brute_force(spark):
    v = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    got = queries.op2_topk_search(spark, SF)
    assert sorted(map(tuple, got.collect())) == brute.top_k(v, 5)


def test_top_k_odd_vectors(spark):
    v = [(0, [0.5, -0.25]), (1, [0.5, -0.25]), (2, [0.5, -0.25]), (3, None), (4, [1.0, None]), (5, [float("nan"), 1.0]), (6, [float("inf"), 1.0]), (50, [1e6, 2e6]), (100, [0.1]), (None, [1.0, 1.0])]
    df = spark.createDataFrame([(i, x, 1) for i, x in v], "vec_id long, embedding array<double>, score int")
    assert sorted(map(tuple, topk_search.top_k(df, "vec_id % 50 = 0", 5).collect())) == brute.top_k(v, 5)
    assert topk_search.top_k(df.limit(0), "vec_id % 50 = 0").count() == 0


def test_search_block_prunes_exactly():
    rng = np.random.default_rng(3)
    c = rng.integers(-50, 50, (40, 700))
    c[:, 100:300] = c[:, [7]]
    ids, q = np.arange(700)[::-1].copy(), c[:, [7, 150, 3]]
    got = topk_search.search_block(ids[[7, 150, 3]], q, ids, c, 4, step=8)
    want = []
    for j, i in zip(range(3), ids[[7, 150, 3]]):
        s = q[:, j] @ c
        want += sorted((-int(s[k]), int(ids[k])) for k in range(700) if ids[k] != i)[:4]
    assert [(-int(s), int(v)) for v, s in zip(got[1], got[2])] == want


# 3 decontamination


def test_decontamination(spark):
    rng = random.Random(1)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(5))
    items = [[word() for _ in range(n)] for n in (30, 25, 12, 8, 4)]
    filler = lambda n: [word() for _ in range(n)]
    exact = filler(50) + items[0] + filler(50)
    changed = items[1].copy()
    for k in (3, 9, 16, 21):
        changed[k] = "zzz"
    texts = [" ".join(exact), ("! ".join(filler(20) + changed)).upper(), " ".join(filler(200)), " ".join(items[2]), " ".join(["q", *items[3], "w"]), " ".join(items[4]), None, "", " ".join(items[0][:15] + filler(15)), " ".join(items[0] + items[1])]
    bench = spark.createDataFrame([(i, " ".join(t), "x") for i, t in enumerate(items)] + [(9, None, "x"), (0, " ".join(items[0]), "x")], "item_id long, text string, doc_id string")
    df = frame(spark, texts)
    for pass_bytes in (1 << 20, 200):  # one pass, several passes
        got = rows(decontaminate.contaminated(df, bench, pass_bytes))
        assert {i: r["item_ids"] for i, r in got.items()} == {0: [0], 1: [1], 2: [], 3: [2], 4: [3], 5: [], 6: [], 7: [], 8: [], 9: [0, 1]}
        assert all(r["contaminated"] == bool(r["item_ids"]) for r in got.values())
    assert decontaminate.contaminated(df.limit(0), bench).count() == 0
    assert not any(r["contaminated"] for r in rows(decontaminate.contaminated(df, bench.limit(0))).values())


@pytest.mark.parametrize("n", [*range(5, 21), 27])
def test_seeds_hit_every_accepted_substitution(n):
    item = [f"w{k}" for k in range(n)]
    index = decontaminate.SeedIndex([(7, " ".join(item))])
    size = min(decontaminate.WINDOW, n)
    for at in {0, (n - size) // 2, n - size}:
        most = max(e for e in range(size) if size - e >= decontaminate.MIN_SHARE * size)
        changed = [set(c) for e in range(most + 1) for c in itertools.combinations(range(at, at + size), e)]
        h = np.stack([np.where([at <= k < at + size and k not in c for k in range(n)], index.tokens[0], np.uint64(k0 + 1)) for k0, c in enumerate(changed)])
        hits = index.hits(h.ravel(), np.arange(len(changed) + 1) * n)
        assert set(hits[hits[:, 2] == 0, 0].tolist()) == set(range(len(changed)))
        assert all(index.overlap(x, 0, 0) for x in h)


def test_decontamination_finds_items_of_the_driver(spark, docs):
    bench = [(r["item_id"], brute.lower(r["text"])) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    got = rows(queries.op3_decontaminate(spark, SF))
    whole = {i for i, t in docs.items() if any(len(b.split()) >= 5 and b in brute.lower(t) for _, b in bench)}
    assert whole and whole <= {i for i, r in got.items() if r["contaminated"]}


def test_decontamination_equals_its_rule(spark):
    rng = random.Random(8)
    items = [[f"w{rng.randrange(40)}" for _ in range(n)] for n in (5, 6, 9, 12, 15, 19, 20, 24, 33)] + [["x"] * 9, ["x", "y"] * 12]
    texts = []
    for _ in range(120):
        t = [f"w{rng.randrange(40)}" for _ in range(rng.randrange(0, 60))]
        for _ in range(rng.randrange(3)):
            part = list(rng.choice(items))
            for _ in range(rng.randrange(6)):
                part[rng.randrange(len(part))] = "z"
            at = rng.randrange(len(t) + 1)
            t[at:at] = part[rng.randrange(3) :]
        texts.append(t)
    texts += [["x"] * 30, ["x", "y"] * 20, ["y", "x", "x"] * 9]
    bench = spark.createDataFrame([(k, " ".join(t)) for k, t in enumerate(items)], "item_id long, text string")
    got = rows(decontaminate.contaminated(frame(spark, [" ".join(t) for t in texts]), bench))
    want = {d: {k: m for k, item in enumerate(items) if (m := brute.overlap(t, item, decontaminate.WINDOW, decontaminate.MIN_SHARE, decontaminate.MIN_TOKENS))} for d, t in enumerate(texts)}
    assert {d: (r["item_ids"], r["matched"]) for d, r in got.items()} == {d: (sorted(w), max(w.values(), default=0)) for d, w in want.items()}
    assert 30 < sum(bool(w) for w in want.values()) < 120


def test_repetitive_texts_cost_their_length():
    index = decontaminate.SeedIndex([(0, "x " * 1000), (1, "x y " * 500)])
    h = index.tokens[0][:1].repeat(4000)
    start = time.perf_counter()
    hits = index.hits(h, np.array([0, 4000]))
    assert len(hits[hits[:, 1] == 0]) > 4900 and time.perf_counter() - start < 3
    assert decontaminate._differences(np.arange(5000), np.arange(0, 3000, 2)).tolist() == list(range(-2998, 5000))


# 4 near duplicates


def test_near_duplicates_match_all_pairs(spark, docs):
    want = brute.near_components(docs.items(), 2, 80)
    got = rows(queries.op4_near_dedup(spark, SF))
    assert {i: (r["n_shingles"], r["component_id"]) for i, r in got.items()} == want
    assert all(r["kept"] == (r["component_id"] == i) for i, r in got.items())


def test_near_duplicates_edges(spark, odd):
    df, texts = odd
    got = [(r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in near_dedup.near_duplicates(df, 2, 80).collect()]
    want = brute.near_components(texts.items(), 2, 80)
    assert len(got) == len(texts) + 1
    assert {g[0]: g[1:3] for g in got} == want
    assert near_dedup.near_duplicates(df.limit(0)).count() == 0


def test_near_duplicates_large_group_and_chain(spark):
    rng = random.Random(2)
    base = [f"w{k}" for k in range(120)]
    texts = []
    for _ in range(300):
        t = base.copy()
        for _ in range(rng.randrange(1, 6)):
            t[rng.randrange(120)] = f"v{rng.randrange(10**6)}"
        texts.append(" ".join(t))
    chain = [f"c{k}" for k in range(100)]
    for k in range(30):
        texts.append(" ".join(chain[k * 3 :] + [f"d{j}" for j in range(k * 3)]))
    got = rows(near_dedup.near_duplicates(frame(spark, texts), 2, 80))
    assert {i: r["component_id"] for i, r in got.items()} == {i: c for i, (_, c) in brute.near_components(list(enumerate(texts)), 2, 80).items()}


def test_near_duplicates_just_over_the_threshold_in_a_template_group(spark):
    texts = brute.straddling_group(random.Random(11), 2, 160, 40)
    want = {i: c for i, (_, c) in brute.near_components(list(enumerate(texts)), 2, 80).items()}
    got = rows(near_dedup.near_duplicates(frame(spark, texts), 2, 80))
    assert len(set(want.values())) < len(texts) - 30
    assert {i: r["component_id"] for i, r in got.items()} == want


def test_near_duplicates_in_groups_a_little_over_small_nodes(spark):
    texts = [t for k in range(25) for t in brute.straddling_group(random.Random(100 + k), 2, 16, 3)]
    want = {i: c for i, (_, c) in brute.near_components(list(enumerate(texts)), 2, 80).items()}
    got = rows(near_dedup.near_duplicates(frame(spark, texts), 2, 80))
    assert {i: r["component_id"] for i, r in got.items()} == want


def python_nodes_a_stage(plan):
    """The most Python nodes between two exchanges of a plan's text; each takes a worker of its own in every task."""
    above, most = [], 0
    for line in plan.splitlines():
        if name := re.search(r"[A-Za-z]\w*", line):
            above = [x for x in above if x[0] < name.start()]
            n = (above[-1][1] if above else 0) + bool(re.search("Python|Pandas|Arrow", name[0]))
            most = max(most, n)
            above.append((name.start(), 0 if "Exchange" in name[0] else n))
    return most


def test_near_duplicates_take_one_python_worker_a_task(spark, monkeypatch):
    plans, write = [], sparkkit.Table.__init__

    def spy(self, session, df, name):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        write(self, session, df, name)

    monkeypatch.setattr(sparkkit.Table, "__init__", spy)
    near_dedup.near_duplicates(frame(spark, brute.straddling_group(random.Random(11), 2, 160, 40)), 2, 80)
    assert any("FlatMapGroupsInArrow" in p for p in plans) and max(map(python_nodes_a_stage, plans)) == 1
    one = spark.range(3).mapInArrow(lambda batches: batches, "id long")
    assert [python_nodes_a_stage(x._jdf.queryExecution().executedPlan().toString()) for x in (one, one.mapInArrow(lambda batches: batches, "id long"), one.repartition(2, "id").mapInArrow(lambda batches: batches, "id long"))] == [1, 2, 1]


def test_members_of_large_nodes_are_joined_with_their_sets_only(spark, monkeypatch):
    plans, write = [], sparkkit.Table.__init__

    def spy(self, session, df, name):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        write(self, session, df, name)

    monkeypatch.setattr(sparkkit.Table, "__init__", spy)
    near_dedup.near_duplicates(frame(spark, brute.straddling_group(random.Random(11), 2, 160, 40)), 2, 80)
    large = [p for p in plans if "FlatMapGroupsInArrow" in p]
    assert large and all(len(re.findall(r"Join \[id#\d+L\], \[id#\d+L\], Inner", p)) == 1 for p in large)


# 5 personal data

PIECES = ["a", "b.c", "@", "x@y.z", "+", "1", "23", "+1 (234) 567-8901", "4111 1111 1111 1111", "4111111111111111", "10.0.0.256", "1.2.3.4", ".", "-", " ", "\n", "é", "300.1", "@@", "ssn: 123-45-6789", "https://u:p@h.com"]


@settings(max_examples=400, deadline=None)
@given(st.lists(st.sampled_from(PIECES), max_size=14))
def test_pii_equals_patterns(parts):
    text = "".join(parts)
    got = pii.find_spans(text, AUTOMATON)
    assert {k: got[k] for k in pii.KINDS} == brute.pii(text)


AUTOMATON = pii.build_automaton()


def test_pii_whole_table(spark, docs):
    got = rows(queries.op5_pii(spark, SF))
    assert sum(r["n_email"] + r["n_ip"] + r["n_card"] + r["n_phone"] for r in got.values()) > 0
    for i, t in docs.items():
        want = brute.pii(t)
        base = ",".join(f"{k}:{a}:{b}" for k in pii.KINDS for a, b in want[k])
        assert got[i]["base_sha256"] == hashlib.sha256(base.encode()).hexdigest()
        assert got[i]["spans"].startswith(base)


def test_pii_extra_kinds_and_edges(spark, odd):
    s = pii.find_spans("SSN: 123-45-6789 or iban DE44 and postgres://bob:pw@db.local/x", AUTOMATON)
    assert s["account"] == [(5, 16)] and len(s["url_login"]) == 1
    assert pii.scan_documents(odd[0]).count() == odd[0].count()
    assert pii.scan_documents(odd[0].limit(0)).count() == 0


# 6 BPE tree


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(["a", "'", "'s", "'re", "ll", " ", "  ", "\n", "\t", "1", "23", "!", "é", "日本", "\x1c", "　", "word", " the", "''", "r", "e"]), max_size=60))
def test_bpe_tree_equals_whole_encoding(parts):
    text = "".join(parts)
    enc, lengths, table = bpe_tree.load_encoding(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    got = bpe_tree.encode(text, enc, lengths, leaf=3).ids
    assert got == enc.encode_ordinary(text)
    assert bpe_tree.decode(got, table, leaf=2) == text.encode()


def test_bpe_whole_table(spark, docs, odd):
    enc = brute.tiktoken_encoding()
    for got, texts in ((rows(queries.op6_bpe_tree(spark, SF)), docs), (rows(bpe_tree.encode_documents(odd[0], public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))), odd[1])):
        for i, t in texts.items():
            ids = enc.encode_ordinary(t or "")
            assert (got[i]["n_tokens"], got[i]["ids_sha256"]) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest())
            assert got[i]["decoded_sha256"] == hashlib.sha256((t or "").encode()).hexdigest()


# 7 repeats


def test_repeats_whole_table(spark, docs):
    got = rows(queries.op7_repeat_removal(spark, SF))
    assert {i: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for i, r in got.items()} == brute.repeats(docs.items())


def test_repeats_edges(spark, odd):
    df, texts = odd
    got = repeat_removal.remove_repeats(df).collect()
    want = brute.repeats(texts.items())
    assert len(got) == len(texts) + 1
    for r in got:
        assert (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) == want[r["doc_id"]]
    same = spark.createDataFrame([(1, "q" * 60), (1, "z" * 70), (2, "z" * 70), (None, "q" * 60)], "doc_id long, text string")
    assert sorted((str(r["doc_id"]), r["n_bytes"], r["n_removed"]) for r in repeat_removal.remove_repeats(same).collect()) == [("1", 60, 0), ("1", 70, 0), ("2", 70, 70), ("None", 60, 0)]
    assert repeat_removal.remove_repeats(df.limit(0)).count() == 0


@settings(max_examples=15, deadline=None)
@given(st.lists(st.text("ab", max_size=120), max_size=12))
def test_repeated_runs_small_alphabet(texts):
    """The kernel without Spark: runs judged and compared as the stages do."""
    length, seed = 16, 8
    want = brute.repeats(list(enumerate(texts)), length)
    import pyarrow as pa

    from gridloom.llm.textkit import chunks

    got = list(chunks(pa.array(range(len(texts)), pa.int64()), pa.array(texts, pa.string()), 1 << 30))
    if not got:
        return
    ids, buf, offs = got[0]
    text, start, n, h, g = repeat_removal.find_runs(buf, offs, length, seed)
    c = {"doc": text.astype(np.int64), "h": h.astype(np.uint32), "g": g}
    early = repeat_removal.led_by_smaller(c)
    rest = np.flatnonzero(~early)
    flag = early.astype(np.uint8)
    flag[rest] = repeat_removal.judge_bucket({k: v[rest] for k, v in c.items()})
    gone = np.zeros(len(buf), bool)
    opened = np.flatnonzero(flag == 2)
    for k in np.flatnonzero(flag == 1):
        a = offs[text[k]] + start[k]
        gone[a : a + n[k] + length - 1] = True
    starts = np.concatenate([offs[text[k]] + start[k] + np.arange(n[k]) for k in opened]) if len(opened) else np.zeros(0, int)
    hit = repeat_removal.longest_previous_factors(buf, starts, np.repeat(text[opened], n[opened]), length) >= length
    for a in starts[hit]:
        gone[a : a + length] = True
    assert {i: int(gone[offs[i] : offs[i + 1]].sum()) for i in range(len(texts))} == {i: w[1] for i, w in want.items()}


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text("ab", min_size=1, max_size=30), min_size=1, max_size=8), st.sampled_from([3, 8, 11]))
def test_longest_previous_factors(texts, length):
    data = [t.encode() + bytes([k + 1]) * length for k, t in enumerate(texts)]  # own endings: matches never cross documents
    buf, doc, starts, base = np.frombuffer(b"".join(data), np.uint8), [], [], 0
    for k, t in enumerate(data):
        starts += range(base, base + len(t) - length + 1)
        doc += [k] * (len(t) - length + 1)
        base += len(t)
    got = repeat_removal.longest_previous_factors(buf, np.array(starts), np.array(doc), length)
    raw = bytes(buf)
    common = lambda x, y: next((i for i in range(length) if raw[x + i] != raw[y + i]), length)
    assert got.tolist() == [max((common(x, y) for y, e in zip(starts, doc) if e < d), default=0) for x, d in zip(starts, doc)]


# 8 lines


def test_lines_edges(spark, odd):
    df, texts = odd
    extra = frame(spark, ["  A Long Line HERE \nx\nA LONG LINE here", "a long line here\n\x0ba long line here\ttail", None, "a long line here", "É long LINE one\né long line one", "é long line ONE"], 100)
    got = line_dedup.dedup_lines(df.unionByName(extra).withColumn("words", F.lit(1)).withColumn("_n", F.lit(2)))
    kept = {r["doc_id"]: (r["n_lines"], r["n_dropped"], r["kept_text"], r["text"]) for r in got.collect()}
    assert got.columns[:4] == df.columns
    assert kept[100][:3] == (3, 0, "  A Long Line HERE \nx\nA LONG LINE here")
    assert kept[101][:3] == (2, 1, "\x0ba long line here\ttail")
    assert kept[102][:3] == (1, 0, "") and kept[103][:3] == (1, 1, "")
    assert kept[104][:2] == (2, 0) and kept[105][:3] == (1, 1, "")
    assert kept[3][:3] == (1, 0, "one") and kept[9][0] == 61
    assert line_dedup.dedup_lines(df.limit(0)).count() == 0


def test_lines_native(spark):
    plan = queries.op8_line_dedup(spark, SF)._jdf.queryExecution().toString() + queries.op1_chat_format(spark, SF)._jdf.queryExecution().toString()
    assert not re.search("Python|Arrow|Pandas", plan)


# 9 toxicity


def test_toxicity_held_out(spark):
    got = rows(queries.op9_toxicity(spark, "/root/testdata/sf0.1"))
    labels = {r["doc_id"]: r["toxic"] for r in spark.read.parquet("/root/testdata/sf0.1/labels.parquet").collect()}
    assert all(r["held_out"] == (brute.crc_mod3(i) == 1) for i, r in got.items())
    held = [(got[i]["predicted"], y, got[i]["score"]) for i, y in labels.items() if i in got and got[i]["held_out"]]
    right = sum(p == y for p, y, _ in held) / len(held)
    found = sum(p for p, y, _ in held if y) / max(1, sum(y for _, y, _ in held))
    assert right > 0.98 and found >= 0.9
    assert all(0 <= s <= 1 for _, _, s in held)


def test_toxicity_folding_and_exceptions(spark, odd):
    lex = toxicity.Lexicon({toxicity.fold("idiot") + "$": 5.0, toxicity.fold("trash") + "$": 4.0, toxicity.fold("lowei"): 3.0, "~bêt": 2.0})
    a = lex.automata()
    total = lambda t: toxicity.measure(t, a)[0]
    assert total("an IDIOT!") == total("an 1d10t") == total("an іdіоt") == total("an i\u200bdiot") == total("an ìdîot") == 5.0
    assert total("idiotic") == 0 and total("loweichen") == 3.0 and total("xlowei") == 0
    assert total("a trash can") == 0 and total("trash") == 4.0 and total("idiot idiot") == 5.0
    assert total("BÊTe") == 2.0 and total("bete") == total("béte") == 0
    got = toxicity.score_documents(odd[0].withColumn("score", F.lit(7)), lex, ["doc_id", "score"])
    assert got.columns == ["doc_id", "score", "predicted"] and got.count() == odd[0].count() and got.agg(F.max("score")).first()[0] <= 1
    labels = spark.createDataFrame([], "doc_id long, toxic int")
    empty = toxicity.fit(odd[0], labels)
    assert empty.weights == {} and {r["predicted"] for r in toxicity.score_documents(odd[0], empty).collect()} == {0}
    assert spark.createDataFrame([(None,), (1,)], "doc_id long").select(toxicity.held_out()).collect()[0][0] is False


def test_toxicity_equals_plain_matching(spark, docs):
    weights = {"the$": 1.0, "th": 0.5, "er": 0.7, "~é": 0.9, "~réa": 1.5, "~über$": 2.0, "iich": 1.2}
    lex = toxicity.Lexicon(weights, [-1.0, 0.3, 0.2, 0.1, -0.4], none=0.125)
    texts = spark.createDataFrame(sorted(docs.items()), "doc_id long, text string")
    got = {r["doc_id"]: r["score"] for r in toxicity.score_documents(texts, lex).collect()}
    for i, t in docs.items():
        want = brute.toxicity(t or "", weights, lex.coef, 0.125, toxicity.fold, toxicity.fold_light)
        assert abs(got[i] - want) < 1e-9


# 10 token files


def test_token_files(spark, docs, odd):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    got = rows(queries.op10_token_files(spark, SF))
    start = 0
    for i in sorted(docs):
        ids = t.encode(docs[i] or "", add_special_tokens=False).ids + [0]
        assert (got[i]["start"], got[i]["n_tokens"], got[i]["ids_crc32"]) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    table = token_files.token_table(odd[0], public_tokenizers.path("byte_bpe_50k.json")).collect()
    assert len(table) == odd[0].count()
    for r in table:
        ids = t.encode(odd[1][r["doc_id"]] or "", add_special_tokens=False).ids + [0]
        assert (r["n_tokens"], r["ids_crc32"]) == (len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
    nulls = spark.createDataFrame([(None, "a b"), (5, "c"), (None, None)], "doc_id long, text string")
    assert sorted((str(r["doc_id"]), r["n_tokens"]) for r in token_files.token_table(nulls, public_tokenizers.path("byte_bpe_50k.json")).collect())[0] == ("5", 2)
    with pytest.raises(ValueError):
        token_files.write_token_files(nulls, public_tokenizers.path("byte_bpe_50k.json"), "/tmp/never-written", end_id=70_000)
    assert token_files.token_table(odd[0].limit(0), public_tokenizers.path("byte_bpe_50k.json")).count() == 0


def test_starts_follow_part_numbers(spark):
    index = [(f"file:/x/data/part-{p}-c000.txt", d, 0, n, 1) for p, d, n in (("00000", 1, 5), ("00002", 2, 7), ("99999", 3, 11), ("100000", 4, 2), ("100001", 5, 1))]
    got = token_files.with_starts(spark.createDataFrame(index, "file string, doc_id long, offset long, n_tokens long, ids_crc32 long"))
    assert sorted((r["doc_id"], r["start"]) for r in got.collect()) == [(1, 0), (2, 5), (3, 12), (4, 23), (5, 25)]


def test_pieces_with_one_hash_are_told_apart(monkeypatch):
    enc = token_files.PieceEncoder(public_tokenizers.path("byte_bpe_50k.json"), "<u2")
    enc.table = [token_files._Known(enc.dtype)]
    monkeypatch.setattr(token_files, "range_hash", lambda prefix, starts, ends: (ends - starts).astype(np.uint64) * np.uint64(16))
    texts = ["some words here and some more words", "here other words stay there", "one two six ten two"]
    for _ in range(2):
        assert [np.frombuffer(b, "<u2").tolist() for b in enc.encode_batch(texts)] == [enc.tokenizer.encode(t, add_special_tokens=False).ids for t in texts]


def test_records_detect_damage():
    data = token_files.frame(b"abc\n") + token_files.frame(b"")
    assert [(a, p) for a, p in token_files.unframe(data)] == [(0, b"abc\n"), (21, b"")]
    for k in range(len(data) - 1):
        if k in (20, 37):  # the record's closing line feed carries nothing
            continue
        bad = data[:k] + bytes([data[k] ^ 1]) + data[k + 1 :]
        with pytest.raises(ValueError):
            list(token_files.unframe(bad))


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from(["a", "'", "s", " ", "  ", "\n", "1", "!", "é", "\x1c", "　", "word", "<|endoftext|>", ",", ".", "_", "5"]), max_size=40))
def test_piece_encoder(parts):
    text = "".join(parts)
    enc = token_files.PieceEncoder(public_tokenizers.path("byte_bpe_50k.json"), "<u2")
    assert np.frombuffer(enc.encode_batch([text])[0], "<u2").tolist() == enc.tokenizer.encode(text, add_special_tokens=False).ids


@settings(max_examples=200, deadline=None)
@given(st.lists(st.lists(st.sampled_from([" ab", " ab", ",", ".", "\n", " ", "\n\n", "é", "\xa0", "　", "x" * 70, " tail,", "9.5", "_,"]), max_size=12), min_size=1, max_size=5))
def test_piece_encoder_many_texts(parts):
    texts = ["".join(p) for p in parts]
    enc = token_files.PieceEncoder(public_tokenizers.path("byte_bpe_50k.json"), "<u2")
    assert [np.frombuffer(b, "<u2").tolist() for b in enc.encode_batch(texts)] == [enc.tokenizer.encode(t, add_special_tokens=False).ids for t in texts]
