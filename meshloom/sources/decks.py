"""Decks for an external solver and geometry recipes for a mesher, as text: only what the typed problems say goes in."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meshloom.operators.mesh import ContractError, Mesh
from meshloom.sources.bundles import finite
from meshloom.sources.results import deck_lines


def real(value: float) -> str:
    return f"{finite(value):.17e}"


def module(path: str) -> str:
    """An absolute path that can stand between quotes."""
    if not path.startswith("/") or any(c.isspace() or c == '"' for c in path):
        raise ContractError("a solver module needs an absolute path without blanks or quotes")
    return path


def block(title: str, *lines: str) -> list[str]:
    return [title, *(f"  {x}" for x in lines), "End", ""]


def opening(dimension: int, iterations: int, *more: str) -> list[str]:
    coordinates = f"Coordinate System = Cartesian{' 2D' if dimension == 2 else ''}"
    return block("Header", "CHECK KEYWORDS Warn", 'Mesh DB "." "mesh"') + block("Simulation", coordinates, "Coordinate Mapping(3) = 1 2 3", "Simulation Type = Steady State", f"Steady State Max Iterations = {iterations}", "Output Intervals = 1", 'Output File = "run.result"', "Binary Output = Logical False", *more)


def solver(number: int, equation: str, library: str, procedure: str, variable: str, tolerance: float, *more: str) -> list[str]:
    return block(
        f"Solver {number}", f'Equation = "{equation}"', f'Procedure = File "{module(library)}" "{procedure}"', f'Variable = "{variable}"', "Variable Dofs = 1", "Linear System Solver = Direct",
        "Linear System Direct Method = UMFPACK", "Linear System Abort Not Converged = Logical True", f"Steady State Convergence Tolerance = {real(finite(tolerance, True))}", *more,
    )


def bodies(count: int, force: bool = True) -> list[str]:
    out = []
    for i in range(1, count + 1):
        out += block(f"Body {i}", f"Target Bodies(1) = {i}", "Equation = 1", f"Material = {i}", *([f"Body Force = {i}"] if force else []))
    return out


def conditions(rows: list[tuple[int, str, float]]) -> list[str]:
    """(boundary, keyword, value), numbered in order."""
    out = []
    for i, (boundary, keyword, value) in enumerate(rows, 1):
        out += block(f"Boundary Condition {i}", f"Target Boundaries(1) = {boundary}", f"{keyword} = Real {real(value)}")
    return out


def heat_deck(regions: list[tuple[float, float]], temperatures: list[tuple[int, float]], fluxes: list[tuple[int, float]], library: str, tolerance: float = 1e-12, dimension: int = 2) -> str:
    """Steady heat: regions (conductivity, source), boundaries with temperatures and fluxes."""
    out = opening(dimension, 2) + bodies(len(regions)) + block("Equation 1", "Active Solvers(1) = 1")
    out += solver(1, "Heat Equation", library, "HeatSolver", "Temperature", tolerance, "Nonlinear System Max Iterations = 1")
    for i, (k, q) in enumerate(regions, 1):
        out += block(f"Material {i}", f"Heat Conductivity = Real {real(finite(k, True))}", f"Density = Real {real(1.0)}") + block(f"Body Force {i}", f"Volumetric Heat Source = Real {real(q)}")
    return "\n".join(out + conditions([(b, "Temperature", v) for b, v in temperatures] + [(b, "Heat Flux", v) for b, v in fluxes]))


def current_deck(regions: list[float], potentials: list[tuple[int, float]], fluxes: list[tuple[int, float]], library: str, tolerance: float = 1e-12, dimension: int = 2) -> str:
    """Steady current: conductivities of the regions, boundaries with potentials and current densities."""
    out = opening(dimension, 1) + bodies(len(regions), force=False) + block("Equation 1", "Active Solvers(1) = 1")
    out += solver(1, "Stat Current Solver", library, "StatCurrentSolver", "Potential", tolerance, "Calculate Joule Heating = Logical True", "Calculate Volume Current = Logical True")
    for i, s in enumerate(regions, 1):
        out += block(f"Material {i}", f"Electric Conductivity = Real {real(finite(s, True))}")
    return "\n".join(out + conditions([(b, "Potential", v) for b, v in potentials] + [(b, "Current Density", v) for b, v in fluxes]))


def coupled_deck(regions: list[dict], potentials: list[tuple[int, float]], temperatures: list[tuple[int, float]], current_library: str, heat_library: str, tolerance: float = 1e-10, iterations: int = 100, relaxation: float = 0.5, dimension: int = 2) -> str:
    """Current and heat in turn; a region has sigma, k, and alpha, t_ref of sigma / (1 + alpha (T - t_ref)), or none."""
    out = opening(dimension, iterations) + bodies(len(regions)) + block("Equation 1", "Active Solvers(2) = 1 2")
    out += solver(1, "Stat Current Solver", current_library, "StatCurrentSolver", "Potential", tolerance, "Calculate Joule Heating = Logical True")
    out += solver(2, "Heat Equation", heat_library, "HeatSolver", "Temperature", tolerance, "Nonlinear System Max Iterations = 1", f"Steady State Relaxation Factor = Real {real(finite(relaxation, True))}")
    for i, r in enumerate(regions, 1):
        law = [f"Electric Conductivity = Real {real(finite(r['sigma'], True))}"]
        if r.get("alpha"):
            law = ["Electric Conductivity = Variable Temperature", f'  Real MATC "{real(r["sigma"])}/(1.0+{real(r["alpha"])}*(tx-{real(r["t_ref"])}))"']
        out += block(f"Material {i}", *law, f"Heat Conductivity = Real {real(finite(r['k'], True))}", f"Density = Real {real(1.0)}") + block(f"Body Force {i}", "Joule Heat = Logical True")
    return "\n".join(out + conditions([(b, "Potential", v) for b, v in potentials] + [(b, "Temperature", v) for b, v in temperatures]))


def port_deck(regions: list[tuple[float, float]], walls: list[int], frequency: float, modes: int, selected: int, library: str, tolerance: float = 1e-12) -> str:
    """Port modes: relative permittivity and permeability of the regions, conducting walls."""
    if not 0 <= selected < modes:
        raise ContractError("the selected mode isn't one of those asked for")
    out = opening(2, 1) + bodies(len(regions), force=False) + block("Equation 1", "Active Solvers(1) = 1")
    out += solver(1, "Port mode", library, "EMPortSolver", "Port", tolerance, f"Angular Frequency = Real {real(6.283185307179586 * finite(frequency, True))}", "Use Piola Transform = Logical True", "Calculate Nodal Field = Logical True", f"Eigenfunction Index = Integer {selected + 1}", "Eigen Analysis = Logical True", f"Eigen System Values = Integer {modes}", "Eigen System Compute Residuals = Logical True")
    for i, (e, m) in enumerate(regions, 1):
        out += block(f"Material {i}", f"Relative Permittivity = Real {real(finite(e, True))}", f"Relative Permeability = Real {real(finite(m, True))}")
    for i, w in enumerate(walls, 1):
        out += block(f"Boundary Condition {i}", f"Target Boundaries(1) = {w}", "Port {e} = Real 0.0")
    return "\n".join(out)


def tetra_deck(regions: list[tuple[float | None, float]], potentials: list[tuple[int, float]], temperatures: list[tuple[int, float]], robin: list[tuple[int, float, float]], current_library: str, heat_library: str, tolerance: float = 1e-12) -> str:
    """Current in the regions with a conductivity and heat in all, of (sigma or None, k); Robin faces (boundary, h, ambient)."""
    out = opening(3, 1)
    for i, (sigma, _) in enumerate(regions, 1):
        out += block(f"Body {i}", f"Target Bodies(1) = {i}", f"Equation = {1 if sigma is not None else 2}", f"Material = {i}", *(["Body Force = 1"] if sigma is not None else []))
    out += block("Equation 1", "Active Solvers(2) = 1 2") + block("Equation 2", "Active Solvers(1) = 2") + block("Body Force 1", "Joule Heat = Logical True")
    out += solver(1, "Stat Current Solver", current_library, "StatCurrentSolver", "Potential", tolerance, "Calculate Joule Heating = Logical True") + solver(2, "Heat Equation", heat_library, "HeatSolver", "Temperature", tolerance)
    for i, (sigma, k) in enumerate(regions, 1):
        out += block(f"Material {i}", *([f"Electric Conductivity = Real {real(finite(sigma, True))}"] if sigma is not None else []), f"Heat Conductivity = Real {real(finite(k, True))}", f"Density = Real {real(1.0)}")
    out += conditions([(b, "Potential", v) for b, v in potentials] + [(b, "Temperature", v) for b, v in temperatures])
    for i, (b, h, ambient) in enumerate(robin, len(potentials) + len(temperatures) + 1):
        out += block(f"Boundary Condition {i}", f"Target Boundaries(1) = {b}", f"Heat Transfer Coefficient = Real {real(finite(h, True))}", f"External Temperature = Real {real(ambient)}")
    return "\n".join(out)


def tagged_deck(mesh: Mesh, regions: list[str], boundaries: list[str]) -> dict[str, DataFrame]:
    """Deck lines whose bodies and boundary numbers are the places of tags in the lists; the tags must cover every cell and
    every facet exactly once."""
    spark = mesh.cells.sparkSession
    top = 3 if mesh.corners == 4 else 2
    out = {}
    for dim, names, table, key in ((top, regions, mesh.cells, "cell_id"), (top - 1, boundaries, mesh.facets, "facet_id")):
        numbers = spark.createDataFrame([(n, i + 1) for i, n in enumerate(names)], "name string, body int")
        tagged = mesh.tags.where(F.col("dim") == dim).join(F.broadcast(numbers), "name").select(F.col("entity_id").alias(key), "body")
        if tagged.groupBy(key).count().where("count > 1").limit(1).count() or table.join(tagged, key, "left_anti").limit(1).count():
            raise ContractError("the tags don't cover everything exactly once")
        out[key] = tagged
    lines = deck_lines(mesh, out["cell_id"])
    moved = lines["boundary"].join(out["facet_id"], F.col("line_no") == F.col("facet_id"))
    p = F.split("value", " ")
    lines["boundary"] = moved.select("line_no", F.concat_ws(" ", F.slice(p, 1, 1), F.array(F.col("body").cast("string")), F.slice(p, F.lit(3), F.size(p) - 2)).alias("value"))
    return lines


def joint_bodies(current: DataFrame, heat: DataFrame) -> DataFrame:
    """(cell_id, body): one number for each pair of regions that two partitions(cell_id, region) make of the cells; both must
    cover the same cells."""
    both = current.withColumnRenamed("region", "one").join(heat.withColumnRenamed("region", "other"), "cell_id", "full")
    if both.where("one IS NULL OR other IS NULL").limit(1).count():
        raise ContractError("the partitions are of different cells")
    pairs = both.select("one", "other").distinct().orderBy("one", "other").limit(10_000).collect()
    table = current.sparkSession.createDataFrame([(r.one, r.other, i + 1) for i, r in enumerate(pairs)], "one string, other string, body int")
    return both.join(F.broadcast(table), ["one", "other"]).select("cell_id", "body")


# --- geometry recipes -------------------------------------------------------------------------------------------------


def rectangle(first: int, width: float, height: float, size: str) -> list[str]:
    """Four points and lines around the origin, counter-clockwise, numbered from ``first``."""
    corners = [(-1, -1), (1, -1), (1, 1), (-1, 1)]
    points = [f"Point({first + i}) = {{{real(sx * width / 2)}, {real(sy * height / 2)}, 0, {size}}};" for i, (sx, sy) in enumerate(corners)]
    lines = [f"Line({first + i}) = {{{first + i}, {first + (i + 1) % 4}}};" for i in range(4)]
    return points + lines + [f"Curve Loop({first}) = {{{', '.join(str(first + i) for i in range(4))}}};"]


def waveguide_recipe(width: float = 4e-6, height: float = 3e-6, core_width: float = 0.5e-6, core_height: float = 0.22e-6, size: float = 0.4e-6, core_size: float = 0.08e-6, unit: float = 1e-6) -> str:
    """A rectangular core in a rectangular cladding, in units of ``unit`` metres."""
    values = [finite(v, True) / finite(unit, True) for v in (width, height, core_width, core_height, size, core_size)]
    if values[2] >= values[0] or values[3] >= values[1] or values[5] > values[4]:
        raise ContractError("the core must lie in the cladding, and be meshed as finely at least")
    w, h, cw, ch, s, cs = values
    out = ['SetFactory("Built-in");', f"outer_size = {real(s)};", f"core_size = {real(cs)};", *rectangle(1, w, h, "outer_size"), *rectangle(5, cw, ch, "core_size")]
    out += ["Plane Surface(1) = {1, 5};", "Plane Surface(2) = {5};", 'Physical Surface("cladding") = {1};', 'Physical Surface("core") = {2};']
    out += [f'Physical Curve("{n}") = {{{i}}};' for i, n in enumerate(("bottom", "right", "top", "left"), 1)]
    return "\n".join([*out, "Mesh.MshFileVersion = 4.1;", "Mesh.Binary = 0;", "Mesh.ElementOrder = 1;", ""])


#: Sizes at interfaces and elsewhere, in metres, of three refinements.
PROFILES = {"coarse": (0.28e-6, 1.28e-6), "medium": (0.14e-6, 0.64e-6), "fine": (0.07e-6, 0.32e-6)}


def mesh_profile(name: str) -> tuple[float, float]:
    if name not in PROFILES:
        raise ContractError("a mesh profile is coarse, medium or fine")
    return PROFILES[name]


def ring_recipe(profile: str = "coarse", radius: float = 5e-6, core_width: float = 0.5e-6, core_height: float = 0.22e-6, heater_width: float = 2e-6, heater_height: float = 0.14e-6, gap: float = 2e-6, domain: float = 20e-6, oxide: float = 2e-6, cladding: float = 2.8e-6, substrate: float = 0.5e-6, opening: float = 0.5, unit: float = 1e-6) -> str:
    """A ring of silicon in oxide with an open ring heater above and a terminal at each of its ends, as solids."""
    fine, bulk = (v / unit for v in mesh_profile(profile))
    r, cw, ch, hw, hh, g, d, ox, cl, sub = (finite(v, True) / unit for v in (radius, core_width, core_height, heater_width, heater_height, gap, domain, oxide, cladding, substrate))
    if not (0 < opening < 3.0 and r + hw / 2 < d / 2 and g + hh < cl and r > max(cw, hw) / 2):
        raise ContractError("the ring and its heater must fit in the domain")
    box = lambda n, z, height: f"Box({n}) = {{{real(-d / 2)}, {real(-d / 2)}, {real(z)}, {real(d)}, {real(d)}, {real(height)}}};"
    tube = lambda n, z, width, height, angle: [f"Cylinder({n}) = {{0, 0, {real(z)}, 0, 0, {real(height)}, {real(r + width / 2)}, {real(angle)}}};", f"Cylinder({n + 1}) = {{0, 0, {real(z)}, 0, 0, {real(height)}, {real(r - width / 2)}, {real(angle)}}};", f"BooleanDifference({n + 2}) = {{ Volume{{{n}}}; Delete; }}{{ Volume{{{n + 1}}}; Delete; }};"]
    out = ['SetFactory("OpenCASCADE");', box(1, -ox - sub, sub), box(2, -ox, ox), box(3, 0, cl), *tube(10, 0, cw, ch, 6.283185307179586), *tube(20, ch + g, hw, hh, 6.283185307179586 - opening)]
    out += ["BooleanFragments{ Volume{1, 2, 3}; Delete; }{ Volume{12, 22}; Delete; }", 'Physical Volume("ring") = {12};', 'Physical Volume("heater") = {22};', 'Physical Volume("substrate") = {1};']
    out += [f"Mesh.MeshSizeMin = {real(fine)};", f"Mesh.MeshSizeMax = {real(bulk)};", "Mesh.Algorithm3D = 10;", "Mesh.MshFileVersion = 4.1;", "Mesh.Binary = 0;", ""]
    return "\n".join(out)
