"""Records out of text logs, as expressions on a text column; nothing leaves the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The numbers, markers and tables of a program's logs, as that program prints them.
FLOAT = r"[-+]?\d+\.?\d*(?:[eE][-+]?\d+)?"


def let(value: Column, body) -> Column:
    """body(value) with the value worked out once, however often body names it."""
    return F.transform(F.array(value), body)[0]


def matches(text: Column, pattern: str, group: int = 0) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(group))


def last(items: Column) -> Column:
    return F.try_element_at(items, F.lit(-1))


def lines_with(text: Column, pattern: str) -> Column:
    return matches(text, rf"(?im)^.*{pattern}.*$")


def number(text: Column) -> Column:
    return text.try_cast("double")


def last_float(line: Column) -> Column:
    return number(last(matches(line, FLOAT)))


def total_energy(text: Column) -> Column:
    """The last token of the last line with the final energy; null if that is no number."""
    return number(F.regexp_extract(last(lines_with(text, "FINAL SINGLE POINT ENERGY")), r"(\S+)\s*$", 1))


def first_energy(text: Column) -> Column:
    return number(F.regexp_extract(text, r"FINAL SINGLE POINT ENERGY\s+(-?\d+\.\d+)", 1))


def enthalpy(text: Column) -> Column:
    """The last number of the last such line that has one."""
    return last_float(last(F.filter(lines_with(text, "TOTAL ENTHALPY"), lambda x: F.rlike(x, F.lit(FLOAT)))))


def gibbs(text: Column) -> Column:
    return last_float(last(F.filter(lines_with(text, "FINAL GIBBS"), lambda x: F.contains(F.upper(x), F.lit("FREE")) & F.rlike(x, F.lit(FLOAT)))))


def dipole(text: Column, first: bool = False) -> Column:
    found = matches(text, r"(?i)Magnitude\s*\(Debye\)\s*:\s*([\d.]+)", 1)
    return number(F.try_element_at(found, F.lit(1)) if first else last(found))


def spin_square(text: Column) -> Column:
    return number(F.try_element_at(matches(text, r"<S\*\*2>\s*:\s*([\d.]+)", 1), F.lit(1)))


def block(text: Column, marker: str, which: str = "last") -> Column:
    """Lines after the last (or first) line with a marker; null if there is none. One pass over the text."""
    parts = F.split(text, rf"(?i){marker}[^\n]*(?:\n|$)", -1 if which == "last" else 2)
    return let(parts, lambda p: F.when(F.size(p) > 1, F.split(F.element_at(p, -1), "\n")))


def until(lines: Column, stop) -> Column:
    """Lines before the first for which stop(line) holds."""

    def cut(found: Column) -> Column:
        at = F.array_position(F.transform(found, lambda x: stop(x)), True).cast("int")
        return let(at, lambda a: F.when(a > 0, F.slice(found, 1, a - 1)).otherwise(found))

    return let(lines, cut)


def rows(lines: Column, pattern: str, fields: list[tuple[str, str]]) -> Column:
    """A struct for each line that matches, its groups by name and type."""
    found = F.filter(lines, lambda x: F.rlike(x, F.lit(pattern)))
    cut = F.transform(found, lambda x: F.split(F.regexp_replace(x, f"{pattern}.*$", "\x01".join(f"${i + 1}" for i in range(len(fields)))), "\x01"))
    return F.transform(cut, lambda x: F.struct(*(x[i].cast(kind).alias(name) for i, (name, kind) in enumerate(fields))))


def table_lines(lines: Column, pattern: str, heading: str) -> Column:
    """The lines of a table: from its first row to the first line after it that is neither a row, nor
    blank, a rule or a heading."""
    other = lambda x: ~F.rlike(x, F.lit(pattern)) & (F.trim(x) != "") & ~F.rlike(x, F.lit(rf"(?i)^\s*(?:[-*]|{heading})"))

    def body(found: Column) -> Column:
        start = F.array_position(F.transform(found, lambda x: F.rlike(x, F.lit(pattern))), True).cast("int")
        return let(start, lambda a: F.when(a > 0, F.slice(found, F.greatest(a, F.lit(1)), 1_000_000)))

    return until(let(lines, body), other)


def charges(text: Column) -> Column:
    """Atom rows of the last charge block, to a blank line or the sum."""
    lines = F.slice(block(text, "MULLIKEN ATOMIC CHARGES"), 2, 1_000_000)
    body = until(lines, lambda x: (F.trim(x) == "") | F.contains(F.upper(x), F.lit("SUM")))
    return rows(body, r"^\s*(\d+)\s+([A-Za-z]+)\s*:\s*([-\d.]+)", [("atom_index", "int"), ("symbol", "string"), ("charge", "double")])


def gap(text: Column) -> Column:
    """First empty orbital after the occupied ones, less the last occupied one, in the last block."""
    found = rows(F.slice(block(text, "ORBITAL ENERGIES"), 1, 499), r"^\s*(\d+)\s+([\d.]+)\s+(-?[\d.]+)\s+(-?[\d.]+)\s*$", [("no", "int"), ("occ", "double"), ("eh", "double"), ("ev", "double")])

    def between(levels: Column) -> Column:
        start = F.array_position(F.transform(levels, lambda o: o["occ"] > 0), True).cast("int")
        return let(F.when(start > 0, F.slice(levels, F.greatest(start, F.lit(1)), 1_000_000)), first_gap)

    def first_gap(tail: Column) -> Column:
        empty = F.array_position(F.transform(tail, lambda o: o["occ"] <= 0), True).cast("int")
        return let(empty, lambda e: F.when(e > 1, F.round(F.try_element_at(tail, e)["ev"] - F.try_element_at(tail, F.greatest(e - 1, F.lit(1)))["ev"], 6)))

    return let(found, between)


#: A line of a table of modes: number, frequency and two more numbers.
MODE = r"^\s*(\d+):\s+([-+]?\d+\.?\d*)\s+([-+]?\d+\.?\d*)\s+([-+]?\d+\.?\d*)"


def raman(text: Column) -> Column:
    """Modes of the last Raman table, without those within 10 of zero; null if there is no table."""
    found = rows(table_lines(block(text, r"\bRAMAN\s+SPECTRUM\b"), MODE, "mode|freq|activity|depol"), MODE, [("mode", "int"), ("freq", "double"), ("activity", "double"), ("depolarization", "double")])
    return F.filter(found, lambda m: F.abs(m["freq"]) > 10)


def orbitals(text: Column) -> Column:
    """Of the first orbital block, up to a blank line and a new section: the highest occupied and lowest
    empty energies over both spins, their gap, and whether spins are told apart. Null without a block."""
    body = F.regexp_extract(text, r"(?s)ORBITAL ENERGIES\n-+\n(.*?)(?=\n\n\S|\Z)", 1)
    found = rows(F.split(body, "\n"), r"^\s*(\d+)\s+([\d.]+)\s+(-?[\d.]+)\s+(-?[\d.]+)\s*$", [("no", "int"), ("occ", "double"), ("eh", "double"), ("ev", "double")])
    energies = lambda which: F.transform(F.filter(found, which), lambda o: o["eh"])
    homo, lumo = F.array_max(energies(lambda o: o["occ"] > 0)), F.array_min(energies(lambda o: o["occ"] == 0))
    gap_of = lumo - homo
    return F.when(body != "", F.struct(homo.alias("homo_eh"), lumo.alias("lumo_eh"), gap_of.alias("gap_eh"), (gap_of * 27.211386245988).alias("gap_ev"), F.rlike(body, F.lit("SPIN (UP|DOWN) ORBITALS")).alias("open_shell")))


def population(text: Column) -> Column:
    """The population analysis: 150 lines from its summary on, else 800 from its first heading, else
    the last 200 of the text."""
    lines = F.split(text, "\n")
    says = lambda x, *words: F.forall(F.array(*map(F.lit, words)), lambda w: F.contains(F.upper(x), w))
    at = lambda which: F.array_position(F.transform(lines, which), True).cast("int")
    summary = at(lambda x: says(x, "NATURAL POPULATION ANALYSIS", "SUMMARY"))
    heading = at(lambda x: says(x, "NBO", "ANALYSIS") | says(x, "NATURAL POPULATIONS") | says(x, "NPA", "NATURAL"))
    cut = F.when(summary > 0, F.slice(lines, F.greatest(summary, F.lit(1)), 150)).when(heading > 0, F.slice(lines, F.greatest(heading, F.lit(1)), 800))
    return F.array_join(F.coalesce(cut, F.slice(lines, F.greatest(F.size(lines) - 199, F.lit(1)), 200)), "\n")


def convergence(text: Column) -> Column:
    """ok, not_converged (a normal end without the optimisation's own) or error."""
    ended = F.contains(text, F.lit("ORCA TERMINATED NORMALLY"))
    return F.when(~ended, "error").when(F.contains(F.upper(text), F.lit("THE OPTIMIZATION HAS CONVERGED")), "ok").otherwise("not_converged")


def mode_status(text: Column) -> Column:
    """(status, code): a warning if a mode is below -10."""
    low = F.exists(vibrations(text), lambda m: m["freq"] < -10)
    return F.struct(F.when(low, "warning").otherwise("ok").alias("status"), F.when(low, "IMAG_FREQ").alias("code"))


def scan_geometries(text: Column) -> Column:
    """The last geometry of each step of a scan, "" where a step has none; none without steps."""
    parts = F.slice(F.split(text, r"(?i)RELAXED\s+SURFACE\s+SCAN\s+STEP\s+(?=\d)"), 2, 1_000_000)
    return F.transform(parts, lambda p: F.coalesce(geometry(p), F.lit("")))


def detectors(text: Column) -> Column:
    """What two readers of the same log say: the plain one and one that wants the whole line, whether
    they agree about the end, and about the self-consistent field (one tells failure, one success)."""
    plain, strict = F.contains(text, F.lit("ORCA TERMINATED NORMALLY")), F.rlike(text, F.lit(r"\*{4,}ORCA TERMINATED NORMALLY\*{4,}"))
    u = F.upper(text)
    says = lambda *parts: [F.contains(u, F.lit(p)) for p in parts]
    scf, imag, cas = says("SCF NOT CONVERGED", "FAILED TO CONVERGE"), says("***IMAGINARY MODE***"), says("THE CAS PROCEDURE HAS NOT CONVERGED", "CASSCF ORBITAL OPTIMIZATION DID NOT CONVERGE", "CAS PROCEDURE DID NOT CONVERGE")
    code = F.when(scf[0] | scf[1], "SCF_NOT_CONVERGED").when(imag[0], "IMAG_FREQ").when(cas[0] | cas[1] | cas[2] | (F.contains(u, F.lit("CASSCF")) & F.contains(u, F.lit("NOT CONVERGED"))), "CASSCF_NOT_CONVERGED")
    converged = F.rlike(text, F.lit(r"SCF CONVERGED AFTER\s+\d+ CYCLES"))
    failed = F.coalesce(code == "SCF_NOT_CONVERGED", F.lit(False))
    return F.struct(plain.alias("ok"), strict.alias("strict_ok"), (plain == strict).alias("ok_agree"), code.alias("code"), converged.alias("scf_converged"), (failed != converged).alias("scf_agree"), F.octet_length(text).cast("long").alias("size_bytes"))


def vibrations(text: Column) -> Column:
    """Imaginary modes from their list, real ones from the last spectrum; none within 10 of zero."""
    low = rows(F.split(text, "\n"), r"(?i)^\s+(\d+):\s+([-+]?\d+\.?\d*)\s+cm\*\*-1\s+\*+imaginary", [("mode", "int"), ("freq", "double")])
    low = F.transform(low, lambda m: F.struct(m["mode"].alias("mode"), m["freq"].alias("freq"), F.lit(0.0).alias("intensity")))
    real = rows(table_lines(block(text, r"\bIR\s+SPECTRUM\b"), MODE, r"mode|freq|cm\*\*"), MODE, [("mode", "int"), ("freq", "double"), ("eps", "double"), ("intensity", "double")])
    real = F.coalesce(F.transform(real, lambda m: F.struct(m["mode"].alias("mode"), m["freq"].alias("freq"), m["intensity"].alias("intensity"))), F.array().cast("array<struct<mode: int, freq: double, intensity: double>>"))
    both = let(low, lambda found: F.concat(found, F.filter(real, lambda m: ~F.exists(found, lambda o: o["mode"] == m["mode"]))))
    return F.array_sort(F.filter(both, lambda m: F.abs(m["freq"]) > 10))


def excited_states(text: Column) -> Column:
    found = rows(block(text, "ABSORPTION SPECTRUM VIA TRANSITION ELECTRIC DIPOLE MOMENTS"), r"^\s+\d+-\S+\s*->\s*(\d+)-\S+\s+([\d.]+)\s+[\d.]+\s+([\d.]+)\s+([\d.]+(?:[eE][+-]?\d+)?)", [("state", "int"), ("ev", "double"), ("nm", "double"), ("fosc", "double")])
    return F.transform(found, lambda s: F.struct(s["state"].alias("state"), F.round(s["ev"], 4).alias("ev"), F.round(s["nm"], 2).alias("nm"), F.round(s["fosc"], 6).alias("fosc")))


def root_energies(text: Column) -> Column:
    """Energies by root, the last one told for a root."""
    pattern = r"(?i)(?:E\[SA-CASSCF\]\s+)?\bROOT\s+(\d+)\s*:\s*(?:E\s*=\s*)?(-\d+\.\d+)\s*Eh"
    pairs = F.arrays_zip(matches(text, pattern, 1).alias("r"), matches(text, pattern, 2).alias("e"))
    told = F.transform(pairs, lambda p, i: F.struct(p["r"].cast("int").alias("root"), i.alias("at"), p["e"].cast("double").alias("energy")))
    last_told = lambda all_told: F.filter(all_told, lambda t: ~F.exists(all_told, lambda o: (o["root"] == t["root"]) & (o["at"] > t["at"])))
    return F.transform(F.array_sort(let(told, last_told)), lambda t: t["energy"])


def status(text: Column) -> Column:
    """ok, energy and the first error line of a finished run."""
    ok = F.rlike(text, F.lit(r"\*+ORCA TERMINATED NORMALLY\*+"))
    line = F.trim(F.try_element_at(matches(text, r"(?m)^\s*(?:\d+\s+)?(?:\[file .*?\]:\s*)?Error \([^)]*\):.*$"), F.lit(1)))
    return F.struct(F.when(ok, "ok").otherwise("error").alias("status"), F.when(ok, first_energy(text)).alias("energy"), F.when(~ok, F.coalesce(line, F.lit("ORCA did not terminate normally (no error line matched)"))).alias("error"))


def geometry(text: Column) -> Column:
    """Atom lines of the last coordinate block, with or without a number in front."""
    body = until(F.slice(block(text, r"CARTESIAN COORDINATES \(ANGSTROEM\)"), 2, 1_000_000), lambda x: F.size(F.filter(F.split(x, r"\s+"), lambda w: w != "")) < 4)
    atom = lambda x: F.filter(F.split(x, r"\s+"), lambda w: w != "")
    return F.array_join(F.transform(body, lambda x: F.array_join(F.when((F.size(atom(x)) >= 5) & F.rlike(atom(x)[0], F.lit(r"^[+-]?\d+$")), F.slice(atom(x), 2, 4)).otherwise(F.slice(atom(x), 1, 4)), " ")), "\n")


def tail(text: Column, n: int) -> Column:
    lines = F.split(text, "\n")
    return F.array_join(F.slice(lines, F.greatest(F.size(lines) - n + 1, F.lit(1)), n), "\n")


def error_summary(text: Column, keywords: list[str], last_lines: int = 1200, most: int = 60) -> Column:
    """The last lines that have a keyword, out of the last lines of the text."""
    lines = F.split(text, "\n")
    recent = F.slice(lines, F.greatest(F.size(lines) - last_lines + 1, F.lit(1)), last_lines)
    hits = F.filter(recent, lambda x: F.rlike(F.upper(x), F.lit("|".join(k.upper() for k in keywords))))
    return F.array_join(F.slice(hits, F.greatest(F.size(hits) - most + 1, F.lit(1)), most), "\n")


def json_block(text: Column) -> Column:
    """From the first { to the last }, if that is JSON."""
    found = F.regexp_extract(text, r"(?s)(\{.*\})", 1)
    return F.when(F.get_json_object(found, "$").isNotNull(), found)


def json_balanced(text: Column) -> Column:
    """The first JSON object of a reply: thoughts and code fences go, then the text from the first brace
    to the one that closes it. Braces within strings don't count. Null if none closes or it is no JSON."""
    bare = F.trim(F.regexp_replace(text, r"(?s)<think>.*?</think>", ""))
    bare = F.regexp_replace(bare, r"(?s)^```(?:json)?\s*\n?(.*?)\n?```$", "$1")
    rest = F.substr(bare, F.locate("{", bare))
    begin = F.struct(F.lit(0).alias("depth"), F.lit(False).alias("quoted"), F.lit(False).alias("escaped"), F.lit(0).alias("at"), F.lit(0).alias("end"))

    def step(s: Column, c: Column) -> Column:
        quote = (c == '"') & ~s["escaped"]
        depth = F.when(s["quoted"], s["depth"]).when(c == "{", s["depth"] + 1).when(c == "}", s["depth"] - 1).otherwise(s["depth"])
        closed = (s["end"] == 0) & ~s["quoted"] & (c == "}") & (depth == 0)
        return F.struct(depth.alias("depth"), F.when(quote, ~s["quoted"]).otherwise(s["quoted"]).alias("quoted"), (s["quoted"] & (c == "\\") & ~s["escaped"]).alias("escaped"), (s["at"] + 1).alias("at"), F.when(closed, s["at"] + 1).otherwise(s["end"]).alias("end"))

    end = F.aggregate(F.split(rest, ""), begin, step, lambda s: s["end"])
    found = F.when((F.locate("{", bare) > 0) & (end > 0), F.substr(rest, F.lit(1), end))
    return F.when(F.get_json_object(found, "$").isNotNull(), found)


def scan_steps(text: Column) -> Column:
    """Energies by step: the summary table, else the last energy of each step, else all energies."""
    fields = [("step", "int"), ("value", "double"), ("energy", "double")]
    marker = r"(?:(?:RELAXED|RIGID)\s+SURFACE\s+SCAN\s+(?:SUMMARY|RESULTS)|(?:SUMMARY|RESULTS)\s+OF\s+(?:THE\s+)?(?:RELAXED|RIGID)\s+SURFACE\s+SCAN)"
    table = rows(block(text, marker, "first"), r"^\s+(\d+)\s+(?:\S+:\s*)?([-+]?\d+\.?\d*)\s+([-+]?\d+\.\d+)", fields)
    parts = F.slice(F.split(text, r"(?i)RELAXED\s+SURFACE\s+SCAN\s+STEP\s+"), 2, 1_000_000)
    energy = r"(?i)FINAL\s+SINGLE\s+POINT\s+ENERGY\s+([-+]?\d+\.\d+)"
    steps = F.filter(F.transform(parts, lambda p: F.struct(F.regexp_extract(p, r"^(\d+)", 1).try_cast("int").alias("step"), last(matches(p, energy, 1)).cast("double").alias("energy"))), lambda s: s["energy"].isNotNull())
    steps = F.transform(steps, lambda s, i: F.struct(s["step"].alias("step"), i.cast("double").alias("value"), s["energy"].alias("energy")))
    rest = F.transform(matches(text, energy, 1), lambda e, i: F.struct((i + 1).alias("step"), i.cast("double").alias("value"), e.cast("double").alias("energy")))
    return F.when(F.coalesce(F.size(table), F.lit(0)) > 0, table).when(F.size(steps) > 0, steps).otherwise(rest)


def sanitized(label: Column) -> Column:
    """Letters, digits and _.- only, runs of underscores as one; "job" if nothing is left."""
    clean = F.regexp_replace(F.regexp_replace(F.replace(F.trim(F.coalesce(label, F.lit(""))), F.lit(" "), F.lit("_")), r"[^A-Za-z0-9_.-]+", "_"), "_+", "_")
    clean = F.btrim(clean, F.lit("_"))
    return F.when(clean == "", "job").otherwise(clean)


def ion(name: Column) -> Column:
    """(symbol, charge, electrons' parity) of an element or ion: Fe, Fe3+, Fe+3, Cl-. Multiplicity is 1
    or 2 by the number of electrons, null for elements without a known number."""
    from .geometry import ATOMIC_NUMBERS, by_key

    pattern = r"^([A-Z][a-z]?)(?:(\d*)([+-])|([+-])(\d+))?$"
    group = lambda i: F.regexp_extract(F.trim(name), pattern, i)
    sign = F.coalesce(F.nullif(group(3), F.lit("")), group(4))
    size = F.coalesce(F.nullif(group(2), F.lit("")), F.nullif(group(5), F.lit("")), F.lit("1")).try_cast("int")
    charge = F.when(sign == "+", size).when(sign == "-", -size).otherwise(0)
    electrons = by_key({k: float(v) for k, v in ATOMIC_NUMBERS.items()}, group(1)) - charge
    return F.when(F.rlike(F.trim(name), F.lit(pattern)), F.struct(group(1).alias("symbol"), charge.alias("charge"), (electrons % 2 + 1).cast("int").alias("multiplicity")))
