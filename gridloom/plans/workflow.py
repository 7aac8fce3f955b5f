"""Workflows: named inputs, a graph of operations, named outputs and statistics, and the plan of passes over the data.

Nodes are built eagerly (options and grids are checked at once), an operation asked for twice is one
node, and nothing is computed until ``run``. Spark's own planner fuses what shares a pass; this
one decides what Spark can't know: which terrain products share a neighbourhood, and where
a result is needed whole before others can go on (Normalize), whether to store or recompute it.
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.grid import Grid
from gridloom.operators import algebra, focal, reduce, resample, terrain, transfer
from gridloom.raster import Raster

POINTWISE, TERRAIN, ALONE, NORMALIZE, INPUT = "pointwise", "terrain", "alone", "normalize", "input"
_ALGEBRA = {"add": algebra.add, "sub": algebra.sub, "mul": algebra.mul, "min": algebra.minimum, "max": algebra.maximum, "mask": algebra.mask, "clamp": algebra.clamp,
            "reclass": transfer.reclass, "lookup": transfer.lookup, "rescale": transfer.rescale, "rescale_range": transfer.rescale_range}
_FOCAL = {"focal_mean": focal.mean, "focal_min": focal.minimum, "focal_max": focal.maximum, "correlate": focal.correlate, "convolve": focal.convolve, "correlate_separable": focal.correlate_separable}
_TERRAIN = {"dx": lambda *a, **o: terrain.f_gradient("x", *a, **o), "dy": lambda *a, **o: terrain.f_gradient("y", *a, **o), "slope": terrain.f_slope, "aspect": terrain.f_aspect, "hillshade": terrain.f_hillshade,
            "heat_load": terrain.f_heat_load, "orientation": terrain.f_orientation, "curvature": terrain.f_curvature, "ruggedness": terrain.f_ruggedness}


@dataclass(frozen=True)
class Node:
    """One raster of a workflow."""

    id: int
    kind: str
    op: str
    args: tuple
    inputs: tuple
    grid: Grid | None = None
    feature: object = field(default=None, compare=False)


@dataclass
class Pass:
    """One pass over the cells: what it reads, computes, writes and summarises."""

    reads: list[str] = field(default_factory=list)
    stages: list[str] = field(default_factory=list)
    writes: list[str] = field(default_factory=list)
    stats: list[str] = field(default_factory=list)


@dataclass
class Result:
    """What a run returns: rasters by output name, one-row summaries by statistics name."""

    outputs: dict[str, Raster]
    stats: dict[str, DataFrame]


class Workflow:
    """A graph of raster operations."""

    def __init__(self):
        self.nodes: list[Node] = []
        self._known: dict = {}
        self.outputs: dict[str, Node] = {}
        self.summaries: dict[str, Node] = {}

    def _node(self, kind: str, op: str, args: tuple, inputs: tuple = (), grid: Grid | None = None, feature=None) -> Node:
        key = (kind, op, args, tuple(n.id for n in inputs), grid)
        if key not in self._known:
            for n in inputs:
                if n.id >= len(self.nodes) or self.nodes[n.id] is not n:
                    raise ValueError("a node of another workflow")
            self._known[key] = Node(len(self.nodes), kind, op, args, tuple(n.id for n in inputs), grid, feature)
            self.nodes.append(self._known[key])
        return self._known[key]

    def input(self, name: str, grid: Grid | None = None) -> Node:
        """A named input, optionally on a declared grid."""
        if any(n.kind == INPUT and n.op == name and n.grid != grid for n in self.nodes):
            raise ValueError(f"input {name} has another grid")
        return self._node(INPUT, name, (), (), grid)

    def _grid(self, inputs) -> Grid | None:
        grids = {n.grid for n in inputs if n.grid is not None}
        if len(grids) > 1:
            raise ValueError("operands lie on different grids; resample one")
        return next(iter(grids), None)

    def apply(self, op: str, *operands, **options) -> Node:
        """An operation by name: add, sub, ..., slope, ..., focal_mean, ..., normalize."""
        inputs = tuple(x for x in operands if isinstance(x, Node))
        args = tuple(tuple(map(float, x)) if isinstance(x, (list, tuple)) else x for x in operands if not isinstance(x, Node))
        grid, opts = self._grid(inputs), tuple(sorted(options.items()))
        if op in _TERRAIN:
            feature = _TERRAIN[op](*args, **options)
            return self._node(TERRAIN, op, (args, opts), inputs, grid, feature)
        if op == "normalize":
            return self._node(NORMALIZE, op, (), inputs, grid)
        if op in _FOCAL or op in _ALGEBRA:
            check = {"reclass": lambda: transfer._increasing(list(args[0]), "breaks"), "lookup": lambda: transfer._increasing(list(args[0]), "xs"), "rescale_range": lambda: transfer.range_coefficients(*args)}.get(op)
            if check:
                check()
            return self._node(ALONE if op in _FOCAL else POINTWISE, op, args, inputs, grid)
        raise ValueError(f"no operation {op}")

    def resample(self, src: Node, dst: Grid, method: str = "bilinear") -> Node:
        """``src`` on another grid."""
        if src.grid is None:
            raise ValueError("the source needs a grid")
        resample.plan(src.grid, dst, method)
        return self._node(ALONE, "resample", (dst, method), (src,), dst)

    def mosaic(self, sources: list[Node], dst: Grid, method: str = "bilinear") -> Node:
        """Sources over one another."""
        if not sources or any(s.grid is None for s in sources):
            raise ValueError("sources need grids, at least one")
        return self._node(ALONE, "mosaic", (dst, method), tuple(sources), dst)

    def output(self, name: str, node: Node) -> None:
        if name in self.outputs:
            raise ValueError(f"output {name} twice")
        self.outputs[name] = node

    def stats(self, name: str, node: Node) -> None:
        if name in self.summaries:
            raise ValueError(f"statistics {name} twice")
        self.summaries[name] = node

    # planning

    def _live(self) -> set[int]:
        live, todo = set(), [n.id for n in (*self.outputs.values(), *self.summaries.values())]
        while todo:
            i = todo.pop()
            if i not in live:
                live.add(i)
                todo += self.nodes[i].inputs
        return live

    def _phase(self) -> dict[int, int]:
        """The pass in which each live node can be computed: one later behind what must be whole first."""
        phase: dict[int, int] = {}
        for n in self.nodes:
            if n.id not in self._live():
                continue
            p = 0
            for i in n.inputs:
                m = self.nodes[i]
                late = (n.kind == ALONE and m.kind != INPUT) or m.kind == ALONE or n.kind == NORMALIZE or (n.kind == TERRAIN and m.kind != INPUT)
                p = max(p, phase[i] + (1 if late and (m.kind != INPUT or n.kind == NORMALIZE) else 0))
            phase[n.id] = p
        return phase

    def stored(self, boundary: str = "auto") -> set[int]:
        """Nodes that are written between passes."""
        if boundary not in ("auto", "recompute", "cache"):
            raise ValueError(f"no boundary {boundary}")
        phase, out = self._phase(), set()
        for i, p in phase.items():
            n = self.nodes[i]
            readers = [self.nodes[j] for j in phase if i in self.nodes[j].inputs]
            if n.kind == INPUT or not any(phase[r.id] > p for r in readers):
                continue
            must = n.kind == ALONE or any(r.kind in (ALONE, TERRAIN) and phase[r.id] > p for r in readers)
            cheap = self._sources(i) <= 1 and not self._reaches(i)
            if must or boundary == "cache" or (boundary == "auto" and not cheap):
                out.add(i)
        return out

    def _sources(self, i: int) -> int:
        seen, todo = set(), [i]
        while todo:
            k = todo.pop()
            n = self.nodes[k]
            if n.kind in (INPUT, ALONE):
                seen.add(k)
            else:
                todo += n.inputs
        return len(seen)

    def _reaches(self, i: int) -> bool:
        n = self.nodes[i]
        return n.kind in (TERRAIN, ALONE) or any(self._reaches(k) for k in n.inputs)

    def plan(self, boundary: str = "auto") -> list[Pass]:
        """The passes in order."""
        phase, kept = self._phase(), self.stored(boundary)
        passes = []
        for p in range(max(phase.values(), default=-1) + 1):
            here = [self.nodes[i] for i, q in sorted(phase.items()) if q == p and self.nodes[i].kind != INPUT]
            named = [(k, n) for k, n in self.outputs.items() if phase[n.id] == p and (n.kind != INPUT or p == 0)]
            sums = [(k, n) for k, n in self.summaries.items() if phase[n.id] == p]
            if not here and not named and not sums:
                continue
            one = Pass()
            for n in here:
                for i in n.inputs:
                    m = self.nodes[i]
                    if m.kind == INPUT or i in kept and phase[i] < p:
                        one.reads.append(m.op if m.kind == INPUT else f"stored {m.op}")
                    elif phase[i] < p:
                        one.stages.append(f"{m.op} again")
                one.stages.append(n.op if n.kind != TERRAIN else f"{n.op} of one gradient" if sum(x.kind == TERRAIN and x.feature.base == n.feature.base for x in here) > 1 and n.feature.base[0] == "gradient" else n.op)
            one.reads = list(dict.fromkeys(one.reads))
            one.writes = [k for k, _ in named] + [f"stored {n.op}" for n in here if n.id in kept]
            one.stats = [k for k, _ in sums] + [f"range of {self.nodes[n.inputs[0]].op}" for n in self.nodes if n.kind == NORMALIZE and n.id in phase and phase[n.inputs[0]] == p]
            passes.append(one)
        return passes

    def explain(self, boundary: str = "auto") -> str:
        """The plan as text."""
        lines = []
        for k, p in enumerate(self.plan(boundary), 1):
            lines.append(f"pass {k}: read {', '.join(p.reads) or 'nothing'}")
            lines.append(f"  compute {', '.join(p.stages) or 'nothing'}")
            lines += [f"  write {w}" for w in p.writes] + [f"  summarise {s}" for s in p.stats]
        return "\n".join(lines)

    # running

    def run(self, inputs: dict[str, Raster], boundary: str = "auto", exact: bool = True) -> Result:
        """Outputs and statistics for named inputs, which must be just those declared.

        Terrain products of one raster come from one deal of its cells. Stored results are persisted.
        """
        wanted = {n.op for n in self.nodes if n.kind == INPUT}
        if set(inputs) != wanted:
            raise ValueError(f"inputs {sorted(inputs)}, wanted {sorted(wanted)}")
        live, kept = self._live(), self.stored(boundary)
        products: dict[int, DataFrame] = {}
        made: dict[int, Raster] = {}
        for n in self.nodes:
            if n.id not in live:
                continue
            src = [made[i] for i in n.inputs]
            if n.kind == INPUT:
                r = inputs[n.op]
                if n.grid is not None and r.grid is None:
                    r = Raster(r.df, r.width, r.height, n.grid)
            elif n.kind == TERRAIN:
                of = n.inputs[0]
                if of not in products:
                    mates = [m for m in self.nodes if m.id in live and m.kind == TERRAIN and m.inputs == n.inputs]
                    df = terrain.features(src[0], [replace(m.feature, name=f"f{m.id}") for m in mates])
                    products[of] = df.persist() if len(mates) > 1 else df
                r = Raster(products[of].select("y", "x", F.col(f"f{n.id}").alias("v")), src[0].width, src[0].height, src[0].grid)
            elif n.kind == NORMALIZE:
                r = algebra.normalize(src[0])
            elif n.op == "resample":
                r = resample.resample(src[0], *n.args)
            elif n.op == "mosaic":
                r = resample.mosaic(src, *n.args)
            else:
                r = {**_ALGEBRA, **_FOCAL}[n.op](*src, *(list(a) if isinstance(a, tuple) else a for a in n.args))
            if n.id in kept:
                r = Raster(r.df.persist(), r.width, r.height, r.grid)
            made[n.id] = r
        summarise = reduce.stats if exact else reduce.stats_fast
        return Result({k: made[n.id] for k, n in self.outputs.items()}, {k: summarise(made[n.id]) for k, n in self.summaries.items()})
