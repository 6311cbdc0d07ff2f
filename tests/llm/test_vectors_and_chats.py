"""op11, op12 and op13 against plain programs, with the awkward rows."""

import hashlib
import math
import random
from collections import defaultdict

import numpy as np
import pytest

from tessera.llm import annular_pq, chat_format, dual_tree
from tessera.llm.int_vectors import squared

SCHEMA = "vec_id long, embedding array<float>, label int, x string, _id int, cluster string"


def rows_of(n, dim, seed, groups=0, spread=0.02):
    """Vectors, some around a few middles, with nulls, gaps, odd lengths, repeated rows and ties."""
    r = np.random.default_rng(seed)
    middles = r.normal(size=(groups, dim)) if groups else None
    x = (middles[r.integers(0, groups, n)] + spread * r.normal(size=(n, dim)) if groups else r.normal(size=(n, dim))).astype(np.float32)
    out = [(i, [float(v) for v in row], int(i % 3) if i % 7 else None) for i, row in enumerate(x)]
    out += [(n + i, out[3][1], 1) for i in range(9)] + [out[5], out[5]] + [(None, out[8][1], None), (None, [-0.5] * dim, 2)]
    out += [(900, None, 1), (901, [], 1), (902, [1.0] * (dim - 1), 1), (903, [float("nan")] + [0.0] * (dim - 1), 1), (904, [float("inf")] * dim, 0), (905, [None] + [1.0] * (dim - 1), 0)]
    return out


def frame(spark, rows):
    return spark.createDataFrame([(*r, "clash", 1, "clash") for r in rows], SCHEMA).repartition(3)


def kept(rows, dim):
    out = [(i, v, label) for i, v, label in rows if v is not None and len(v) == dim and all(x is not None and math.isfinite(x) for x in v)]
    return [(i, tuple(math.floor(1024 * float(np.float32(x))) for x in v), label, v) for i, v, label in out]


def nearest(v, centres):
    far = [sum((a - b) ** 2 for a, b in zip(v, c, strict=True)) for c in centres]
    return far.index(min(far)), min(far)


def moved(centres, vectors, rounds):
    for _ in range(rounds):
        mine = defaultdict(list)
        for v in vectors:
            mine[nearest(v, centres)[0]].append(v)
        centres = [tuple(sum(x) // len(mine[i]) for x in zip(*mine[i], strict=True)) if i in mine else c for i, c in enumerate(centres)]
    return centres


def said(*centres):
    return hashlib.sha256(",".join(str(x) for c in centres for x in c).encode()).hexdigest()


def plain_lloyd(rows, k, rounds, dim):
    have = kept(rows, dim)
    order = sorted(have, key=lambda r: (r[0] is None, "" if r[0] is None else hashlib.sha256(f"3:{r[0]}".encode()).hexdigest(), r[3]))
    centres = moved([r[1] for r in order[:k]], [r[1] for r in have], rounds)
    at = [(r[0], *nearest(r[1], centres)) for r in have]
    per = defaultdict(int)
    for _, c, far in at:
        per[c] += far
    return sorted(((i, c, far, per[c], sum(per.values()), said(centres[c])) for i, c, far in at), key=str)


@pytest.mark.parametrize(("n", "groups", "k"), [(120, 0, 8), (300, 6, 8), (9, 0, 40), (200, 12, 12)])
def test_dual_tree_equals_plain_lloyd(spark, n, groups, k):
    rows = rows_of(n, 6, n, groups)
    got = dual_tree.lloyd(frame(spark, rows), k, 4, dim=6)
    assert sorted((tuple(r) for r in got.collect()), key=str) == plain_lloyd(rows, k, 4, 6)


def test_dual_tree_of_nothing_and_of_equal_vectors(spark):
    assert dual_tree.lloyd(frame(spark, [(1, None, 1), (2, [1.0], 1)])).collect() == []
    assert dual_tree.lloyd(spark.createDataFrame([], SCHEMA)).collect() == []
    rows = [(i, [0.5] * 3, 1) for i in range(100)] + [(None, [0.5] * 3, 1)]
    got = dual_tree.lloyd(frame(spark, rows), 8, 3, dim=3).collect()
    assert len(got) == 101 and {(r["cluster"], r["distance"], r["inertia"]) for r in got} == {(0, 0, 0)}


def test_dual_tree_prunes_and_covers():
    r = np.random.default_rng(4)
    middles = r.integers(-9000, 9000, (30, 8))
    x = (middles[r.integers(0, 30, 4000)] + r.integers(-60, 60, (4000, 8))).astype(np.int64)
    tree = dual_tree.Tree.over(x, dual_tree.LEAF)
    x = x[tree.order]
    for centre, lo, hi, first, children in tree.nodes:
        away = np.sqrt(squared(x[lo:hi], x[centre : centre + 1])[:, 0])
        at = np.flatnonzero((tree.nodes[:, 0] == centre) & (tree.nodes[:, 1] == lo) & (tree.nodes[:, 2] == hi))
        assert away.max() <= tree.radius[at].max() + 1e-6
        if children:
            kin = tree.nodes[first : first + children]
            assert kin[0][1] == lo and kin[-1][2] == hi and (kin[1:, 1] == kin[:-1, 2]).all()
            assert (tree.radius[first : first + children] <= away.max() / 2 + 1e-6).all()  # the net covers
            apart = squared(x[kin[:, 0]], x[kin[:, 0]]) + np.eye(len(kin), dtype=np.int64) * 10**12
            assert np.sqrt(apart.min()) > away.max() / 2 - 1e-6  # and is separated
    centroids = x[:: 4000 // 16][:16].copy()
    over = dual_tree.Tree.over(centroids, 1)
    label, done = dual_tree.assign(tree, x, over, centroids[over.order])
    assert (label == squared(x, centroids).argmin(1)).all()
    assert done < 0.1 * 16 * 4000  # most nodes are assigned as a whole
    assert dual_tree.Tree.unpack(tree.pack()).nodes.tolist() == tree.nodes.tolist()


def test_components_too_large_are_an_error(spark):
    with pytest.raises(Exception, match="too large"):
        dual_tree.lloyd(frame(spark, [(1, [3e30, 1.0], 1)]), dim=2).collect()


def plain_pq(rows, entries, rounds, parts):
    first = min((r for r in rows if r[0] is not None and r[1] and all(x is not None and math.isfinite(x) for x in r[1])), key=lambda r: (r[0], r[1]))
    dim = len(first[1])
    have, w = kept(rows, dim), dim // parts
    order = sorted(have, key=lambda r: (r[0] is None, r[0] or 0, r[3]))[:entries]
    books = []
    for p in range(parts):
        cut = slice(p * w, (p + 1) * w)
        books.append(moved([r[1][cut] for r in order], [r[1][cut] for r in have], rounds))
    at = []
    for i, v, label, _ in have:
        found = [nearest(v[p * w : (p + 1) * w], books[p]) for p in range(parts)]
        at.append((i, label, "".join(f"{c:02x}" for c, _ in found), sum(far for _, far in found)))
    per = defaultdict(int)
    for _, label, _, far in at:
        per[label] += far
    digest = said(*(c for book in books for c in book))
    return sorted(((i, code, far, per[label], digest) for i, label, code, far in at), key=str)


@pytest.mark.parametrize(("n", "entries"), [(150, 16), (9, 256), (90, 90)])
def test_annular_pq_equals_plain_program(spark, n, entries):
    rows = rows_of(n, 8, n + 1)
    got = annular_pq.quantise(frame(spark, rows), entries, 3)
    assert sorted((tuple(r) for r in got.collect()), key=str) == plain_pq(rows, entries, 3, 4)


def test_annular_pq_of_nothing(spark):
    assert annular_pq.quantise(spark.createDataFrame([], SCHEMA)).collect() == []
    assert annular_pq.quantise(frame(spark, [(1, None, 1), (2, [], 1), (3, [1.0, 2.0, 3.0], 1)])).collect() == []


def test_annulus_prunes_and_keeps_ties():
    r = np.random.default_rng(5)
    size = np.exp(r.uniform(np.log(100), np.log(500000), 2000))
    x = r.normal(size=(2000, 3))
    x = np.floor(x / np.linalg.norm(x, axis=1, keepdims=True) * size[:, None]).astype(np.int64)
    entries = np.concatenate([x[:200], x[:20]])  # the last twenty tie with the first
    code, error, done = annular_pq.Codebook(entries).nearest(x)
    want = squared(x, entries)
    assert (code == want.argmin(1)).all() and (error == want.min(1)).all()
    assert done < 0.5 * want.size
    lying = np.array([[3, 4], [-5, 0], [0, 5], [5, 0]])  # equal norms: the annulus holds both its ends
    assert annular_pq.Codebook(lying).nearest(np.array([[0, 0]]))[0].tolist() == [0]


# --- conversations -----------------------------------------------------------------------------

TEXTS = ["", "plain", "a\\b\\\\", "[INST]x[/INST]</s>", "<s>[\\INST][NEXT]", "[NEXT", "ends in [INST", "\\", "<", "[", "x\n\n", "\n", "日本😀[/SYS]\\", "[ROLE]tool[/ROLE]y[/TURN]", "[[INST]]<<s>>", "</s>[INST] ok [/INST]", None]
ROLES = ["user", "assistant", "system", "tool", "[/ROLE]x\\", "", None]


def conversations(seed=6):
    r = random.Random(seed)
    rows = [(c, r.choice([*range(6), None]), r.choice(ROLES), r.choice(TEXTS)) for c in range(40) for _ in range(r.randint(1, 9))]
    rows += [(100, i, "assistant", t) for i, t in enumerate(TEXTS)] + [(101, 0, "user", "x")] * 3 + [(None, 0, "user", "lost"), (None, 1, "assistant", "[OUT]"), (None, 1, "assistant", "[OUT]")]
    return rows + [(102, i, ROLES[i % 2], "t" * (i % 5)) for i in range(3000)]


def plain_chats(rows):
    groups = defaultdict(list)
    for i, (c, turn, role, text) in enumerate(rows):
        groups[c, i if c is None else 0].append((turn is not None, turn or 0, (role or "").encode(), (text or "").encode()))
    return {k: [(role.decode(), text.decode()) for _, _, role, text in sorted(v)] for k, v in groups.items()}


def test_chats_are_read_back(spark):
    rows = conversations()
    df = spark.createDataFrame([(*r, "clash", 2) for r in rows], "conv_id long, turn long, role string, text string, own string, nth int").repartition(5)
    formatted = chat_format.format_chat(df).cache()
    want = plain_chats(rows)
    got = chat_format.read_chat(formatted).collect()
    assert sorted([(r["conv_id"], [tuple(t) for t in r["turns"]], r["learnt"]) for r in got], key=repr) == sorted([(c, turns, "".join(t for role, t in turns if role == "assistant")) for (c, _), turns in want.items()], key=repr)
    for r in formatted.collect():
        assert r["formatted"].startswith("<s>")
        for s in r["loss"]:  # what is learnt stands behind an assistant's mark or between two of its turns
            assert r["formatted"][: s["start"]].endswith(("[OUT]", "[NEXT]")) and r["formatted"][s["start"] + s["length"] :].startswith(("</s>", "[NEXT]"))
    by_id = {r["conv_id"]: r["formatted"] for r in formatted.collect()}
    assert by_id[101] == "<s>[INST]x[NEXT]x[NEXT]x[/INST]" and by_id[102].count("[OUT]") == 1500
    digests = chat_format.digest(chat_format.read_chat(formatted)).where("conv_id = 100").first()
    assert digests["n_turns"] == len(TEXTS) and digests["loss_chars"] == sum(len(t or "") for t in TEXTS)
    assert digests["turns_sha256"] == hashlib.sha256("".join(f"assistant\n{t or ''}\n" for t in TEXTS).encode()).hexdigest()


def test_chats_stay_in_the_jvm_and_no_rows_give_none(spark):
    df = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert chat_format.digest(chat_format.read_chat(chat_format.format_chat(df))).collect() == []
    plan = chat_format.format_chat(spark.createDataFrame(conversations(), "conv_id long, turn long, role string, text string").repartition(5))._jdf.queryExecution().toString()
    assert "Python" not in plan and plan.split("== Physical Plan ==")[1].count("Exchange hashpartitioning") == 1
