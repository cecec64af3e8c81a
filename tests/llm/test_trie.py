"""The trie of rebuilt conversations against a dictionary of prefixes."""

import hashlib
import random
import zlib

from martwright.llm import prefix_trie as pt

COLUMNS = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves",
           "saved_tokens", "ends_sha256")


def whole(rows, most=5, family=100):
    turns = {}
    for c, turn, role, text in rows:
        if c is not None:
            turns.setdefault(c, []).append((turn is not None, turn, role or "", text or ""))
    turns = {c: [(r, t) for _, _, r, t in sorted(x, key=lambda y: (y[0], y[1] or 0, y[2], y[3]))]
             for c, x in turns.items()}
    out = {}
    for c, own in turns.items():
        h = zlib.crc32(str(c).encode()) % (most + 1)
        base = c - int(c / family) * family
        out[c] = turns.get(c - base, [])[:h] + own[h:]
    return out


def brute(rows):
    convs = whole(rows)
    nodes = {}
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            nodes.setdefault(tuple(turns[:d]), []).append(c)
    if not nodes:
        return set()
    kids, leaves, saved = {}, {}, {}
    for path in nodes:
        if path:
            kids[path[:-1]] = kids.get(path[:-1], 0) + 1
    for path, members in sorted(nodes.items(), key=lambda x: -len(x[0])):
        for up in [path[:d] for d in range(len(path) + 1)] if len(path) < 50 else []:
            leaves[up] = leaves.get(up, 0) + (path not in kids)
            saved[up] = saved.get(up, 0) + (len(members) - 1) * (len(path[-1][1]) if path else 0)
    out = set()
    for path, members in nodes.items():
        ends = ",".join(map(str, sorted(c for c in members if len(convs[c]) == len(path))))
        out.add((min(members), len(path), min(nodes[path[:-1]]) if path else None, len(members),
                 kids.get(path, 0), leaves.get(path), saved.get(path),
                 hashlib.sha256(ends.encode()).hexdigest()))
    return out


def made(spark, rows):
    df = spark.createDataFrame(
        [(*r, 1, "b", None) for r in rows],
        "conv_id long, turn long, role string, text string, blk int, token string, parent string",
    )
    return pt.trie(*pt.rebuilt(pt.turns_in_order(df)))


def found(df):
    return [tuple(r) for r in df.select(*COLUMNS).collect()]


def test_same_as_a_dictionary(spark):
    rng = random.Random(8)
    says = ["", None, "yes", "no", "Ünï", "x" * 300, "word " * 3000]
    rows = []
    for c in rng.sample(range(-150, 400), 260):
        for t in range(rng.choice([0, 1, 2, 3, 6, 9])):
            rows.append((c, rng.choice([t, t, t, 0, None]), rng.choice(["user", "bot", None]),
                         rng.choice(says)))
    rows += rows[:60]  # repeated rows are turns of their own
    rows += [(None, 1, "user", "of no conversation"), (500, None, None, None)]
    got = found(made(spark, rows))
    assert len(got) == len(set(got)) and set(got) == brute(rows)


def test_empty_table_and_single_turns(spark):
    assert found(made(spark, [])) == []
    for rows in ([(7, 0, "user", "x")], [(c, 0, "u", "x") for c in range(1, 30)]):
        assert set(found(made(spark, rows))) == brute(rows)


def test_a_hot_first_turn_and_equal_conversations(spark, monkeypatch):
    monkeypatch.setattr(pt, "PIECE", 7)
    rows = [(c, 0, "user", "hello") for c in range(600)]
    rows += [(c, 1, "bot", f"answer {c}") for c in range(0, 600, 3)]
    rows += [(c, t, "user", "same") for c in range(700, 900) for t in range(4)]
    assert set(found(made(spark, rows))) == brute(rows)


def test_a_very_long_conversation_takes_few_rounds(spark, monkeypatch):
    rounds = []
    plain = pt._round
    monkeypatch.setattr(pt, "_round", lambda *a: rounds.append(1) or plain(*a))
    n = 1500
    rows = [(100, t, "user", "na" if t % 3 else f"turn {t}") for t in range(n)]
    rows += [(c, t, "user", f"{c}") for c in range(3) for t in range(3)]
    df = made(spark, rows).where("conv_id = 100 AND depth > 0").orderBy("depth")
    got = found(df)
    assert [r[1] for r in got] == list(range(1, n + 1))
    assert all(r[3:7] == (1, 0 if r[1] == n else 1, 1, 0) for r in got)
    assert got[-1][7] == hashlib.sha256(b"100").hexdigest()
    assert len(rounds) < 40


def test_blocks_of_a_conversation(spark):
    """A conversation that lies in many ranges has the places of one that lies in one."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        rows = [(1, t // 2, "user", f"{t * 7919 % 1000}") for t in range(2000)]
        df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
        turns = pt.turns_in_order(df)
        assert turns.select("blk").distinct().count() > 1
        assert sorted(r.pos for r in turns.collect()) == list(range(2000))
        assert {r.n for r in turns.collect()} == {2000}
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")


def test_subtree_sums_of_a_random_forest(spark):
    rng = random.Random(2)
    parent = {i: rng.choice([i - 1, i - 1, i - 1, rng.randrange(i)]) for i in range(1, 300)}
    parent[0] = parent[50] = None
    kids = {}
    for i, p in parent.items():
        kids[p] = kids.get(p, 0) + 1
    key = lambda i: None if i is None else f"{i:05}".encode()
    nodes = spark.createDataFrame(
        [(key(i), key(p), kids.get(i, 0), i, 1) for i, p in parent.items()],
        "id binary, parent binary, n_children long, a long, b long",
    )
    want = {i: [0, 0] for i in parent}
    for i in parent:
        up = i
        while up is not None:
            want[up][0] += i
            want[up][1] += 1
            up = parent[up]
    got = {int(bytes(r.id).decode()): [r.a, r.b] for r in pt.subtree_sums(nodes).collect()}
    assert got == want


def _forest(spark, parent):
    kids = {}
    for p in parent.values():
        kids[p] = kids.get(p, 0) + 1
    key = lambda i: None if i is None else f"{i:05}".encode()
    return spark.createDataFrame(
        [(key(i), key(p), kids.get(i, 0), i, 1) for i, p in parent.items()],
        "id binary, parent binary, n_children long, a long, b long",
    )


def test_few_jobs_for_a_deep_tree(spark):
    """What the driver keeps of jobs, stages and plans stays small in however many rounds."""
    nodes = _forest(spark, {i: i - 1 if i else None for i in range(400)})
    sc = spark.sparkContext
    sc.setJobGroup("deep", "sums of a chain")
    try:
        got = {int(bytes(r.id).decode()): (r.a, r.b) for r in pt.subtree_sums(nodes).collect()}
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)
    assert got == {i: (sum(range(i, 400)), 400 - i) for i in range(400)}
    assert len(sc.statusTracker().getJobIdsForGroup("deep")) < 90


def test_a_round_is_one_shuffle(spark):
    live = _forest(spark, {0: None, 1: 0, 2: 1, 3: 1}).selectExpr(
        "id", "'live' AS state", "parent", "CAST(NULL AS binary) AS child", "n_children AS rest",
        "a", "b",
    )
    plan = pt._round(live, 2)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "Join" not in plan


def test_sums_by_one_round_or_many_a_job(spark, monkeypatch):
    rng = random.Random(5)
    parent = {i: rng.choice([i - 1, i - 1, rng.randrange(i)]) for i in range(1, 200)}
    parent[0] = parent[120] = None
    want = {i: [0, 0] for i in parent}
    for i in parent:
        up = i
        while up is not None:
            want[up] = [want[up][0] + i, want[up][1] + 1]
            up = parent[up]
    for few, rounds in ((0, 6), (60, 3), (1000, 9)):
        monkeypatch.setattr(pt, "FEW", few)
        monkeypatch.setattr(pt, "ROUNDS", rounds)
        sums = pt.subtree_sums(_forest(spark, parent)).collect()
        assert {int(bytes(r.id).decode()): [r.a, r.b] for r in sums} == want
