import numpy as np
import pytest

from binloom.config import FilterConfig, read_config, write_config
from binloom.functions import sizing
from binloom.operators import arrange, layout, sketch, tree
from binloom.plans import layouts
from binloom.sources import layout_text


def planned(counts, tmax, alpha=1.2, empty=0.0):
    config = FilterConfig(len(counts), tmax=tmax, alpha=alpha, empty_bin_fraction=empty, disable_estimate_union=True, disable_rearrangement=True)
    made = layout.compute_layout(config, counts, validate=False)
    return made.top_max_bin, set(made.merged), made.placed


@pytest.mark.parametrize(
    ("args", "expected"),
    [
        (([500, 1000] + [500] * 6, 4), (3, {((2,), 22), ((3,), 0)}, [((), 0, 1, 7), ((), 1, 1, 6), ((2,), 0, 22, 3), ((2,), 22, 21, 4), ((2,), 43, 21, 5), ((3,), 0, 42, 1), ((3,), 42, 11, 0), ((3,), 53, 11, 2)])),
        (([500, 1000] + [500] * 6, 5, 1.2, 0.001), (3, {((2,), 0), ((3,), 43)}, [((), 0, 1, 7), ((), 1, 1, 6), ((2,), 0, 21, 3), ((2,), 21, 21, 4), ((2,), 42, 21, 5), ((3,), 0, 43, 1), ((3,), 43, 10, 0), ((3,), 53, 10, 2)])),
        (([50, 1000, 1000, 50, 5, 10, 10, 5], 5), (1, {((0, 0), 45), ((0,), 1)}, [((0, 0), 0, 45, 6), ((0, 0), 45, 13, 5), ((0, 0), 58, 3, 7), ((0, 0), 61, 3, 4), ((0,), 1, 2, 0), ((0,), 3, 2, 3), ((), 1, 2, 2), ((), 3, 2, 1)])),
        (([500] * 4, 4), (0, set(), [((), 0, 1, 3), ((), 1, 1, 2), ((), 2, 1, 1), ((), 3, 1, 0)])),
        (([60, 600, 1000, 800, 800], 5, 1.0), (1, {((0,), 0)}, [((0,), 0, 63, 1), ((0,), 63, 1, 0), ((), 1, 1, 4), ((), 2, 1, 3), ((), 3, 2, 2)])),
        (([11090, 5080, 3040, 1020, 510, 500], 2), (1, {((0, 0), 33), ((0, 1), 0), ((0,), 1), ((1,), 0)}, [((0, 0), 0, 33, 4), ((0, 0), 33, 31, 5), ((0, 1), 0, 57, 2), ((0, 1), 57, 7, 3), ((1,), 0, 53, 0), ((1,), 53, 11, 1)])),
        (([500] * 4, 2, 1.0), (0, {((0,), 0), ((1,), 0)}, [((0,), 0, 32, 2), ((0,), 32, 32, 3), ((1,), 0, 32, 0), ((1,), 32, 32, 1)])),
        (([500] * 8, 2, 1.0), (0, {((0, 0), 0), ((0, 1), 0), ((0,), 0), ((1, 0), 0), ((1, 1), 0), ((1,), 0)}, [((0, 0), 0, 32, 5), ((0, 0), 32, 32, 4), ((0, 1), 0, 32, 7), ((0, 1), 32, 32, 6), ((1, 0), 0, 32, 1), ((1, 0), 32, 32, 0), ((1, 1), 0, 32, 3), ((1, 1), 32, 32, 2)])),
    ],
)
def test_known_layouts(args, expected):
    assert planned(*args) == expected


def simple(counts, bins):
    space = layout.Workspace(np.array(counts), list(range(len(counts))), np.ones(65), 1.0)
    made = layout.Layout()
    return layout.simple_layout(space, bins, (), made), [(ub, n) for _, _, n, ub in made.placed]


def test_simple_layouts():
    assert simple([100, 40, 20, 20], 9) == (0, [(3, 1), (2, 1), (1, 2), (0, 5)])
    assert simple([20] * 4, 4) == (0, [(3, 1), (2, 1), (1, 1), (0, 1)])
    with pytest.raises(ValueError, match="do not fit"):
        simple([100, 40, 20, 20], 2)


def test_every_bin_is_placed_once_with_and_without_unions():
    rng = np.random.default_rng(5)
    counts = rng.integers(20, 4000, 150)
    lines = np.stack([sketch.np_registers(rng.integers(0, 2**63, c, np.int64), 8) for c in counts])
    for unions in (False, True):
        config = FilterConfig(150, tmax=64, disable_estimate_union=not unions).validated()
        made = layout.compute_layout(config, counts, lines)
        assert sorted(ub for *_, ub in made.placed) == list(range(150))
        root = layout.tree(made)
        for node in layout.nodes(root):
            used = [b for tb, n, _ in node.records for b in range(tb, tb + n)] + list(node.children)
            assert sorted(used) == list(range(node.n_tbs))
            assert 0 <= node.max_bin < node.n_tbs
            if node.favourite is None:
                assert node.records[0][0] == node.max_bin


def test_rearrangement():
    shifts = {0: 0, 3: 0, 1: 4000, 6: 4000, 2: 20_000, 4: 20_000, 5: 8000}
    lines = np.stack([sketch.np_registers(np.arange(5000) + shifts[i], 10) for i in range(7)])
    assert layout.rearrange(lines, np.full(7, 5000), list(range(7)), 0.9) == [5, 1, 6, 0, 3, 2, 4]
    # Over several intervals each bin still comes once, within its interval.
    counts = np.array([9000, 8800, 100, 90, 85, 10, 9])
    order = layout.rearrange(lines, counts, list(range(7)), 0.5)
    assert [set(order[a:b]) for a, b in layout.size_intervals(counts, list(range(7)), 0.5)] == [{0, 1}, {2, 3, 4}, {5, 6}]
    assert layout.sort_by_cardinality(np.array([500, 600, 700, 800]), [0, 1, 2, 3]) == [3, 2, 1, 0]


def test_union_estimates():
    line = sketch.np_registers(np.random.default_rng(0).integers(0, 2**63, 1500, np.int64), 5)
    lines, counts = np.stack([line] * 4), np.array([500, 600, 700, 800])
    whole = int(sketch.np_estimate(line))
    assert layout.union_estimates(lines, counts, [0, 1, 2, 3], 3).tolist() == [whole] * 3 + [800]
    assert layout.prefix_estimates(lines, counts, [0, 1, 2, 3]).tolist() == [500] + [whole] * 3


def test_workspace_errors():
    good = dict(counts=np.ones(2), positions=[0, 1], fpr_correction=np.ones(3), relaxed_correction=0.5)
    layout.Workspace(**good).validate()
    for bad in (dict(counts=None), dict(sketches=np.ones((1, 4))), dict(positions=[0, 1, 2]), dict(fpr_correction=np.ones(0)), dict(relaxed_correction=0.0), dict(relaxed_correction=1.1)):
        with pytest.raises(ValueError):
            layout.Workspace(**(good | bad)).validate()
    config = FilterConfig(2, tmax=64)
    with pytest.raises(ValueError, match="sketches"):
        layout.compute_layout(config, [1, 2], None)


TEXT = """#TOP_LEVEL_IBF fullest_technical_bin_idx:111
#LOWER_LEVEL_IBF_0 fullest_technical_bin_idx:0
#LOWER_LEVEL_IBF_2 fullest_technical_bin_idx:2
#LOWER_LEVEL_IBF_1;2;3;4 fullest_technical_bin_idx:22
#USER_BIN_IDX\tTECHNICAL_BIN_INDICES\tNUMBER_OF_TECHNICAL_BINS
7\t0\t1
4\t1;0\t1;22
5\t1;2;3;4;22\t1;1;1;1;21
"""


def test_layout_text(spark):
    made = layout_text.read_layout(TEXT)
    assert made.placed == [((), 0, 1, 7), ((1,), 0, 22, 4), ((1, 2, 3, 4), 22, 21, 5)]
    assert layout_text.write_layout(made) == TEXT
    assert [x.top_max_bin for x in layout_text.read_layouts("@info\n" + TEXT + TEXT)] == [111, 111]
    placed, merged = layout_text.layout_frames(spark, made)
    assert {r[0] for r in layout_text.layout_lines(placed).collect()} == set(TEXT.splitlines()[5:])
    again = layout_text.parse_lines(spark.createDataFrame([(x,) for x in TEXT.splitlines()], "line string"))
    assert sorted(map(str, again.collect())) == sorted(map(str, placed.collect()))
    assert layout_text.layout_of(placed, merged).placed == sorted(made.placed)
    assert layout_text.technical_bins(placed).count() == 44
    for bad in ("", "7\t0\t1\n", TEXT + "x\ty\n", TEXT.replace("#USER", "#user")):
        with pytest.raises(ValueError):
            layout_text.read_layout(bad)
    made.clear()
    assert (made.top_max_bin, made.merged, made.placed) == (0, [], [])


def test_config_text():
    config = FilterConfig(7, maximum_fpr=0.01, empty_bin_fraction=0.1).validated()
    text = "@K\n@k = 20\n@K_END\n@OTHER_CONFIG\n@{}\n@OTHER_CONFIG_END\n" + write_config(config) + "#rest\n"
    assert read_config(text) == config
    assert read_config(write_config(config, "X_CONFIG"), "X_CONFIG") == config
    import json

    body = json.loads("".join(x[1:] for x in write_config(config).splitlines()[1:-1]))["config"]
    old = {k: v for k, v in body.items() if k not in ("empty_bin_fraction", "track_occupancy")} | {"version": 1}
    text = "@A_CONFIG\n@" + json.dumps({"a": old}) + "\n@A_CONFIG_END\n"
    assert read_config(text).empty_bin_fraction == 0.0
    second = {k: v for k, v in body.items() if k != "track_occupancy"} | {"version": 2}
    assert read_config("@A_CONFIG\n@" + json.dumps({"a": second}) + "\n@A_CONFIG_END\n").track_occupancy
    with pytest.raises(ValueError):
        read_config("@A_CONFIG\n@" + json.dumps({"a": second | {"version": 3}}) + "\n@A_CONFIG_END\n")
    for bad in ("", "@A_CONFIG\n@{}\n"):
        with pytest.raises(ValueError):
            read_config(bad)


@pytest.mark.parametrize(
    "bad",
    [dict(number_of_user_bins=0), dict(number_of_user_bins=2**64 - 2), dict(number_of_hash_functions=0), dict(number_of_hash_functions=6), dict(maximum_fpr=0.0), dict(maximum_fpr=1.0), dict(relaxed_fpr=0.0), dict(relaxed_fpr=1.0), dict(relaxed_fpr=0.01), dict(threads=0), dict(sketch_bits=4), dict(sketch_bits=33), dict(tmax=2**64 - 63), dict(empty_bin_fraction=-0.1), dict(empty_bin_fraction=1.0), dict(alpha=-0.1), dict(max_rearrangement_ratio=-0.1), dict(max_rearrangement_ratio=1.1)],
)
def test_config_errors(bad):
    with pytest.raises(ValueError):
        FilterConfig(**({"number_of_user_bins": 10} | bad)).validated()


def test_config_defaults():
    config = FilterConfig(5000, disable_estimate_union=True).validated()
    assert (config.tmax, config.disable_rearrangement) == (128, True)
    assert FilterConfig(10, max_rearrangement_ratio=0.0).validated().disable_rearrangement
    assert FilterConfig(10, empty_bin_fraction=0.5).validated().track_occupancy
    with pytest.warns(UserWarning, match="64"):
        assert FilterConfig(10, tmax=5).validated().tmax == 64


def test_orders_and_intervals(spark):
    df = spark.createDataFrame([(i, c) for i, c in enumerate([5, 9, 9, 1, 7, 100])], "user_bin_id bigint, cardinality bigint")
    got = sorted((r[2], r[0]) for r in arrange.sorted_bins(df).collect())
    assert got == [(0, 5), (1, 1), (2, 2), (3, 4), (4, 0), (5, 3)]
    cut = dict(map(tuple, arrange.intervals(arrange.sorted_bins(df), 0.5).collect()))
    assert cut == {0: 0, 1: 1, 2: 1, 3: 1, 4: 1, 5: 2}
    assert arrange.sorted_bins(df.limit(0)).count() == 0
    assert sizing.divide_and_ceil(7, 7) == 1


def test_unions_are_planned_in_parts(spark, monkeypatch):
    monkeypatch.setattr(tree, "PART", 3)
    monkeypatch.setattr(layouts, "_supplier_counts", lambda *_: pytest.fail("user bins on the driver"))
    rows = layouts.layout_with_unions(spark, "/root/testdata/sf0.001").collect()
    assert sorted(r["user_bin"] for r in rows) == list(range(len(rows))) and len(rows) > 3
    assert {(r["times"], r["inside"], r["alone"]) for r in rows} == {(1, True, True)}
