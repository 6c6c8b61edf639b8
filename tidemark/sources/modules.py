"""Rules as an importable module of column expressions, and back.

The module needs nothing but PySpark: it names its rules and builds, for any table, the
condition of each rule, of all together, and the names of those that hold. The rules are
read back from its text, without running it.
"""

from __future__ import annotations

import ast
import types

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import Row

from tidemark.operators import rules
from tidemark.operators.rules import Atom, Rule

HEAD = '''"""{title}

Made by a rule miner; build(df) gives conditions, mask(df) any of them, names(df) those that hold.
"""

from functools import reduce

from pyspark.sql import functions as F


def _holds(df, feature, op, threshold):
    if feature not in df.columns:
        return F.lit(False)
    x = F.col(feature).cast("double")
    x = F.when(F.isnan(x) | (F.abs(x) == float("inf")), None).otherwise(x)
    found = {{">=": x >= threshold, "<=": x <= threshold, ">": x > threshold, "==": x == threshold}}[op]
    return F.coalesce(found, F.lit(False))


'''
TAIL = '''

def build(df):
    return {name: reduce(lambda a, b: a & b, [_holds(df, *atom) for atom in atoms], F.lit(True)) for name, atoms in RULES.items()}


def mask(df):
    return reduce(lambda a, b: a | b, build(df).values(), F.lit(False))


def names(df, sep=","):
    return F.array_join(F.filter(F.array(*[F.when(c, F.lit(n)) for n, c in build(df).items()]), lambda x: x.isNotNull()), sep)
'''


def source(catalog: list[tuple[str, Rule, dict]], title: str = "Mined rules.") -> str:
    """The module's text for (name, rule, metrics); equal catalogs give equal text.

    Thresholds are written in full, so that the rules that are read back are the same.
    """
    if '"""' in title or "\\" in title:
        raise ValueError("the title can't hold triple quotes or backslashes")
    if len({n for n, _, _ in catalog}) != len(catalog):
        raise ValueError("names of rules differ")
    lines = ["RULES = {"]
    for name, rule, _ in catalog:
        lines.append(f"    {name!r}: [")
        lines += [f"        ({a.feature!r}, {a.op!r}, {float(a.threshold)!r}),  # {a.source}" if a.source else f"        ({a.feature!r}, {a.op!r}, {float(a.threshold)!r})," for a in rules.canonical(rule)]
        lines.append("    ],")
    lines += ["}", "METRICS = {"]
    lines += [f"    {name!r}: {dict(sorted(metrics.items()))!r}," for name, _, metrics in catalog]
    return HEAD.format(title=title) + "\n".join([*lines, "}"]) + "\n" + TAIL


def parsed(text: str) -> list[tuple[str, Rule, dict]]:
    """The catalog in a module's text, which is read as literals and never run."""
    found = {n.targets[0].id: n.value for n in ast.parse(text).body if isinstance(n, ast.Assign) and isinstance(n.targets[0], ast.Name)}
    if "RULES" not in found:
        raise ValueError("no rules in this module")
    table, metrics = ast.literal_eval(found["RULES"]), ast.literal_eval(found["METRICS"]) if "METRICS" in found else {}
    out = []
    for name, atoms in table.items():
        for atom in atoms:
            if len(atom) != 3 or atom[1] not in rules.OPS:
                raise ValueError(f"no atom: {atom!r}")
        out.append((name, rules.canonical(Atom(f, op, float(t)) for f, op, t in atoms), metrics.get(name, {})))
    return out


def loaded(text: str, name: str = "mined_rules") -> types.ModuleType:
    """The module itself, from text that ``source`` made: text of others is parsed, not run."""
    if source(parsed(text), ast.get_docstring(ast.parse(text)).split("\n")[0]) != _bare(text):
        raise ValueError("this module was changed by hand: read it with parsed()")
    module = types.ModuleType(name)
    exec(compile(text, f"<{name}>", "exec"), module.__dict__)
    return module


def _bare(text: str) -> str:
    """Without the notes on where thresholds come from."""
    return "\n".join(line.split("  # ")[0] if line.startswith("        (") else line for line in text.split("\n"))


def write(spark: SparkSession, path: str, catalog: list[tuple[str, Rule, dict]], title: str = "Mined rules.") -> None:
    """To any file system that Spark reaches; a module in place is replaced when the new one is complete."""
    conf, jvm = spark._jsc.hadoopConfiguration(), spark._jvm
    target, new = jvm.org.apache.hadoop.fs.Path(path), jvm.org.apache.hadoop.fs.Path(path + ".new")
    fs = target.getFileSystem(conf)
    out = fs.create(new, True)
    try:
        out.write(bytearray(source(catalog, title).encode()))
    finally:
        out.close()
    fs.delete(target, False)
    if not fs.rename(new, target):
        raise OSError(f"can't put {path} in place")


def read(spark: SparkSession, path: str) -> str:
    rows: list[Row] = spark.read.text(path, wholetext=True).collect()
    return rows[0].value


def catalog_frame(spark: SparkSession, text: str) -> DataFrame:
    """A module's rules as a catalog table."""
    return rules.to_frame(spark, parsed(text))
