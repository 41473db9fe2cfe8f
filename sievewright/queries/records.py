"""Method records made from the table `part`, in SQL that both engines read."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..registry import table


def choose(key: str, values: list[str | None]) -> str:
    """One of the values by a number modulo their count."""
    cases = " ".join(f"WHEN {i} THEN " + ("NULL" if v is None else "'" + v.replace("'", "''") + "'") for i, v in enumerate(values))
    return f"CASE CAST({key} AS BIGINT) % {len(values)} {cases} END"


ELEMENTS = ["C H O", "C H N Fe O", "Cu Cl C H", "C C H H H O", "Zn N C H", "Br C H", "Pd P C H Cl", "C H N S", "Ru C N H", "I Pt N", "H O", None]
FUNCTIONALS = ["B3LYP", "PBE1PBE", "LDA", "M062X", "PBE", "CCSD(T)", "TPSSh", None, "MP2", "", "BP86", "SVWN", "WB97XD", "lda"]
BASES = ["def2TZVP", "GEN", "6-31G(d)", "cc-pVQZ", " def2-SVP ", None, "genecp", "B3LYP", "x=1;y", "weird", "LANL2DZ", "12", "def2-QZVPP", "", "READ"]

RECORDS = f"""SELECT 'e' || p_partkey AS entry_id,
  CASE WHEN p_partkey % 41 = 0 THEN NULL WHEN p_partkey % 3 = 0 THEN 'tmQM' ELSE 'u' || (p_partkey % 29) END AS upload_id,
  split({choose('p_partkey', ELEMENTS)}, ' ') AS elements,
  CAST(1 + p_size % 3 AS INT) AS multiplicity, CAST(p_partkey % 5 - 2 AS INT) AS charge,
  CASE WHEN p_size % 11 = 0 THEN 0 WHEN p_size % 13 = 0 THEN NULL ELSE p_size * 3 END AS n_atoms,
  CASE WHEN p_size % 2 = 0 THEN p_size ELSE NULL END AS n_sites_index,
  {choose('p_partkey / 7', ['SP', 'OPT', 'TDDFT', 'FREQ', 'SCAN', 'NMR'])} AS task_type,
  {choose('p_partkey / 11', ['DFT', 'DFT', 'CCSD', 'CASSCF', 'DFT'])} AS method_family,
  {choose('p_partkey / 3', FUNCTIONALS)} AS functional, {choose('p_partkey / 2', BASES)} AS basis,
  {choose('p_partkey / 5', [None, 'water', '', 'thf'])} AS solvent, {choose('p_partkey / 13', [None, 'D3BJ', None, 'D4'])} AS dispersion,
  {choose('p_partkey / 17', ['RIJCOSX', None])} AS ri_approx, {choose('p_partkey / 19', [None, 'def2/J', 'def2-TZVPP/C'])} AS aux_basis,
  {choose('p_partkey', ['organic_general', 'metal_general', 'TM_general', 'organic_TDDFT', None])} AS specialist_cell,
  p_name AS note, p_retailprice AS energy FROM part"""
# In DuckDB / divides as doubles and CAST rounds; // is its integer division.
RECORDS_SQL = RECORDS.replace(" / ", " // ")


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(RECORDS.replace("FROM part", "FROM {part}").replace("p_partkey / ", "p_partkey DIV "), part=table(spark, sf_dir, "part"))


def sql(body: str) -> str:
    """A DuckDB query over `r`, the records."""
    return f"WITH r AS ({RECORDS_SQL}) {body}"
