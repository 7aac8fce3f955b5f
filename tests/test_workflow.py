import numpy as np
import pytest

from gridloom.grid import Grid
from gridloom.operators import terrain
from gridloom.plans.workflow import Workflow
from gridloom.raster import Raster
from tests.fixtures import ragged, same


def rasters(spark):
    z, ok = ragged(40, 30)
    return Raster.from_numpy(spark, z, ok), Raster.from_numpy(spark, np.roll(z, 3, 0), ok)


def test_one_pass_for_a_terrain_stack_with_statistics(spark):
    w = Workflow()
    d = w.input("dem")
    s = w.apply("slope", d, 10.0)
    w.output("slope", s)
    w.output("shade", w.apply("hillshade", d, 10.0))
    w.output("rough", w.apply("ruggedness", d, kind="roughness"))
    w.stats("slope", s)
    w.apply("aspect", d, 10.0)  # nobody asks for it
    plan = w.plan()
    assert len(plan) == 1 and plan[0].reads == ["dem"] and plan[0].stats == ["slope"] and not any("stored" in x for x in plan[0].writes)
    assert "slope of one gradient" in plan[0].stages and not any("aspect" in x for x in plan[0].stages) and "pass 1: read dem" in w.explain()
    dem, _ = rasters(spark)
    r = w.run({"dem": dem})
    a, b = r.outputs["slope"].to_numpy(), terrain.slope(dem, 10.0).to_numpy()
    assert same(a[0][a[1]], b[0][b[1]]) and r.stats["slope"].first()["count"] == b[1].sum()


def test_a_lone_product_and_statistics_only():
    w = Workflow()
    w.stats("s", w.apply("slope", w.input("dem"), 10.0))
    (only,) = w.plan()
    assert only.stages == ["slope"] and only.writes == [] and only.stats == ["s"]


def test_three_passes_for_the_canopy_chain():
    w = Workflow()
    smooth = w.apply("focal_mean", w.apply("sub", w.input("top"), w.input("ground")), 1)
    w.output("scaled", w.apply("normalize", smooth))
    w.stats("classes", w.apply("reclass", smooth, [0.0], [1.0, 2.0]))
    plan = w.plan()
    assert [p.stages for p in plan] == [["sub"], ["focal_mean"], ["normalize", "reclass"]]
    assert plan[0].writes == ["stored sub"] and "range of focal_mean" in plan[1].stats and "stored focal_mean" in plan[1].writes and plan[2].writes == ["scaled"]


def test_three_passes_for_a_change_between_grids():
    coarse, fine = Grid(20, 15, 2.0, -2.0), Grid(40, 30, 1.0, -1.0)
    w = Workflow()
    change = w.apply("sub", w.input("new", fine), w.resample(w.input("old", coarse), fine))
    w.stats("change", change)
    w.output("scaled", w.apply("normalize", change))
    plan = w.plan()
    assert [p.stages for p in plan] == [["resample"], ["sub"], ["normalize"]] and "stored sub" in plan[1].writes and "range of sub" in plan[1].stats
    with pytest.raises(ValueError):
        w.apply("add", w.input("new", fine), w.input("old", coarse))


def test_boundaries_give_the_same_bits(spark):
    a, b = rasters(spark)
    got = []
    for boundary in ("auto", "recompute", "cache"):
        w = Workflow()
        w.output("n", w.apply("normalize", w.apply("mul", w.input("a"), w.input("b"))))
        got.append(w.run({"a": a, "b": b}, boundary).outputs["n"].to_numpy())
    assert all((g[1] == got[0][1]).all() and same(g[0][g[1]], got[0][0][g[1]]) for g in got)
    w = Workflow()
    w.output("n", w.apply("normalize", w.apply("rescale", w.input("a"), 2.0, 1.0)))
    assert not w.stored("auto") and w.stored("cache")


def test_nodes_are_shared_and_names_checked(spark):
    w = Workflow()
    d = w.input("dem")
    assert w.apply("slope", d, 10.0) is w.apply("slope", d, 10.0) and w.apply("slope", d, 10.0) is not w.apply("slope", d, 10.0, fit=2)
    w.output("a", w.apply("clamp", d, 0.0, 1.0))
    dem, _ = rasters(spark)
    for bad in (lambda: w.output("a", d), lambda: w.run({}), lambda: w.run({"dem": dem, "x": dem}), lambda: w.apply("nothing", d), lambda: w.apply("slope", d, -1.0), lambda: w.plan("never"), lambda: Workflow().apply("add", d, d), lambda: w.resample(d, Grid(2, 2))):
        with pytest.raises(ValueError):
            bad()
