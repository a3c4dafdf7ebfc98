import random

import numpy as np
import pytest

from strandloom.operators import inference as I
from strandloom.operators import junction as J
from strandloom.operators.crf import Factor


def factors(seed, n=7, m=9):
    draw, rng = random.Random(seed), np.random.default_rng(seed)
    card = [draw.randrange(2, 4) for _ in range(n)]
    some = [tuple(draw.sample(range(n), draw.randrange(1, 4))) for _ in range(m)]
    some += [(v,) for v in range(n)]
    return [Factor(v, rng.standard_normal([card[x] for x in v])) for v in some]


@pytest.mark.parametrize("seed", range(6))
@pytest.mark.parametrize("updates", ["HUGIN", "SHSH"])
def test_beliefs_equal_enumeration(seed, updates):
    fs = factors(seed)
    want, z = I.enumerate_exactly(fs)
    for rule in ("MINFILL", "MINNEIGHBORS", "MINWEIGHT", "WEIGHTEDMINFILL"):
        t = J.JunctionTree(fs, J.TreeOptions(updates=updates, heuristic=rule))
        assert t.log_z() == pytest.approx(z)
        for v, p in want.items():
            assert t.belief(v).table == pytest.approx(p)
    for a, b in ((0, 6), (2, 5)):
        assert t.belief(a, b).table == pytest.approx(I.pair_belief(fs, a, b))


@pytest.mark.parametrize("seed", range(4))
def test_best_state(seed):
    fs = factors(seed)
    t = J.JunctionTree(fs, J.TreeOptions(infer="MAXPROD"))
    card = t.card
    best = max(np.ndindex(*[card[v] for v in sorted(card)]), key=lambda s: I.log_score(fs, dict(zip(sorted(card), s, strict=True))))
    assert t.decode() == dict(zip(sorted(card), best, strict=True))


def test_separate_parts_and_bounds():
    fs = [Factor((0, 1), np.array([[0.0, 1.0], [2.0, 0.5]])), Factor((2,), np.array([0.0, -1.0, 1.0]))]
    t = J.JunctionTree(fs)
    want, _ = I.enumerate_exactly([fs[0] * fs[1]])
    assert t.belief(2).table == pytest.approx(want[2]) and t.belief(0, 2).table.sum() == pytest.approx(1)
    assert J.treewidth_bound(fs) == (1, 4.0)
    for code, run in ((J.Code.TOO_LARGE, lambda: J.JunctionTree(fs, J.TreeOptions(max_size=3))), (J.Code.EMPTY, lambda: J.JunctionTree([])), (J.Code.NO_SUCH_VARIABLE, lambda: t.belief(9))):
        with pytest.raises(J.InferenceError) as e:
            run()
        assert e.value.code == code


def test_methods_by_name():
    fs = [Factor((0, 1), np.array([[0.0, 1.0], [2.0, 0.5]])), Factor((1, 2), np.array([[0.3, 1.0], [0.0, 0.5]]))]
    want, _ = I.enumerate_exactly(fs)
    aliases = J.parsed_aliases("# methods\nfast: BP[updates=SEQFIX,tol=1e-9]\ntree: JTREE[updates=SHSH]\n\n")
    for method in ("EXACT", "JTREE", "tree", "fast", "fast[maxiter=50]", "BP[updates=PARALL,tol=1e-10,damping=0.1,weightdecay=1]"):
        found = J.infer(fs, method, aliases)
        assert all(found[v] == pytest.approx(p, abs=1e-6) for v, p in want.items())
    assert J.parsed("fast[tol=1]", aliases) == ("BP", {"updates": "SEQFIX", "tol": "1"})
    assert set(J.infer(fs, "MF[updates=HARDSPIN]")[0]) <= {0.0, 1.0}
    for text, code in (("NOPE", J.Code.UNKNOWN_METHOD), ("BP[x=1]", J.Code.UNKNOWN_PROPERTY), ("BP[tol=x]", J.Code.BAD_PROPERTY), ("BP[tol]", J.Code.BAD_PROPERTY)):
        with pytest.raises(J.InferenceError) as e:
            J.infer(fs, text)
        assert e.value.code == code
    with pytest.raises(J.InferenceError):
        J.parsed_aliases("no colon")
