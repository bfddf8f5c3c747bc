"""Factor sweeps against exploded grids, isotonic fits by ranges against one sequential pass, spreadsheets against what was written."""

import random
import zipfile
from xml.sax.saxutils import escape

import numpy as np
import pytest
from pyspark.sql import functions as F

from causeway.operators import isotonic, models, rescale, sweeps
from causeway.sources import sheets, tables


def measured(spark, n=300):
    rng = random.Random(4)
    rows = [(i, rng.choice([0.0, -1.0, 1.0]) * rng.random() * 9, rng.random(), None if i == 7 else rng.random() * 5) for i in range(n)]
    return spark.createDataFrame(rows, "k long, a double, b double, c double").withColumns({"y": F.col("a") * 2 + F.col("b") + F.coalesce("c", F.lit(0.0)), "t": F.col("b") - F.col("a") / 5})


def test_sweep_of_a_refined_model_equals_a_grid_of_middles(spark):
    rows = measured(spark, 120)
    model = models.fit_refined(rows.fillna(0.0), ["a", "b", "c"], ("y", "t"), 2, boosting={"maxIter": 3, "maxDepth": 3, "maxBins": 6}, numTrees=3, maxDepth=3, maxBins=6)
    at = sweeps.thresholds(model, "a")
    assert at == sorted(set(at)) and 4 <= len(at) <= 12  # at most maxBins - 1 a fit, however many trees
    predict, moved = lambda df: model.transform(df), rows.fillna(0.0).withColumn("a", F.col("a") * 0.55)
    pairs = (("y", "p_y"), ("t", "p_t"))
    ends = sorted({0.2, 6.0, *[t / x for (x,) in moved.select("a").distinct().collect() if x for t in at if 0.2 < t / x < 6.0]})
    middles = [(a + b) / 2 for a, b in zip(ends, ends[1:]) if b - a > 1e-12]
    for kind, objective in (("r2", rescale.Objective(pairs, "r2")), ("mse", rescale.Objective(pairs, "mse"))):
        found = sweeps.sweep_factor(moved, "a", at, predict, pairs, kind, 0.2, 6.0)
        grid = rescale.best_of(rescale.search(moved, "a", middles, predict, objective)).first()
        again = rescale.best_of(rescale.search(moved, "a", [found["factor"]], predict, objective)).first()
        assert found["value"] == pytest.approx(grid["value"], abs=1e-9) and again["value"] == pytest.approx(grid["value"], abs=1e-9)
        coarse = rescale.best_of(rescale.search(moved, "a", rescale.frange(0.2, 6.0, 0.1), predict, objective)).first()
        assert found["value"] >= coarse["value"] - 1e-9


def stepped(df):
    return df.withColumn("p", F.when(F.col("a") <= -2, -4.0).when(F.col("a") <= 1, 0.0).when(F.col("a") <= 4, 5.0).otherwise(11.0) + F.when(F.col("b") <= 0.5, 0.0).otherwise(1.0))


def test_sweep_by_hand(spark):
    rows = measured(spark).withColumn("a", F.when(F.col("k") % 50 == 1, None).when(F.col("k") % 50 == 2, float("nan")).otherwise(F.col("a"))).withColumn("y", F.when(F.col("k") % 40 != 3, F.col("y")))
    at, pairs = [-2.0, 1.0, 4.0], [("y", "p")]
    got = sweeps.losses(rows, "a", at, stepped, pairs, 0.5, 3.0).orderBy("factor").collect()
    local = rows.toPandas()
    for r, after in zip(got, [*got[1:], None]):
        f = (r["factor"] + (after["factor"] if after else 3.0)) / 2
        a = local["a"].astype(float) * f
        p = np.select([a.isna(), a <= -2, a <= 1, a <= 4], [11.0, -4.0, 0.0, 5.0], 11.0) + (local["b"] > 0.5)
        assert r["sse_0"] == pytest.approx(np.nansum((local["y"].astype(float) - p) ** 2), rel=1e-9)
    found, _ = sweeps.greedy_sweep(rows, {"a": at, "b": [0.5]}, stepped, pairs, "mse", 0.5, 3.0)
    assert found["b"]["value"] >= found["a"]["value"] - 1e-12  # a factor of 1 is among them
    parts, scaled = sweeps.cluster_sweep(rows, "a", [(-9.0, 0.0), (0.0, 9.0)], at, stepped, pairs, "mse", 0.5, 3.0)
    assert len(parts) == 2 and scaled.count() == rows.count() and scaled.columns == rows.columns
    none = sweeps.sweep_factor(rows, "a", [], stepped, pairs, "mse", 0.5, 3.0)
    assert (none["low"], none["high"]) == (0.5, 3.0)
    assert np.isnan(sweeps.sweep_factor(rows.limit(0), "a", at, stepped, pairs)["value"])
    for low, high, kind in ((2.0, 1.0, "mse"), (1.0, 2.0, "mae")):
        with pytest.raises(ValueError):
            sweeps.sweep_factor(rows, "a", at, stepped, pairs, kind, low, high)


def test_search_of_tables_with_its_own_names(spark):
    rows = spark.range(20).select(F.col("id").alias("i"), (F.col("id") / 2).alias("factor"), F.col("id").alias("y"))
    found = rescale.search(rows, "factor", [1.0, 2.0, 3.0], lambda df: df.withColumn("p", F.col("factor")), rescale.Objective((("y", "p"),), "mse"))
    assert rescale.best_of(found).first()["factor"] == 2.0 and found.columns == ["i", "factor", "value", "ok"]


def sequential(points):
    """Blocks of sorted (x, n, mean) by one pass over all."""
    out = []
    for x, n, m in points:
        out.append([x, x, n, m])
        while len(out) > 1 and out[-2][3] >= out[-1][3]:
            b, a = out.pop(), out.pop()
            out.append([a[0], b[1], a[2] + b[2], (a[3] * a[2] + b[3] * b[2]) / (a[2] + b[2])])
    return out


@pytest.mark.parametrize("shape", ["noise", "rising", "falling", "waves"])
def test_isotonic_by_ranges_is_the_sequential_fit(spark, shape):
    rng = np.random.default_rng(3)
    x = rng.integers(0, 400, 900).astype(float)
    y = {"noise": rng.normal(size=900), "rising": x + rng.normal(size=900) * 20, "falling": -x, "waves": np.sin(x / 30) * 5 + x / 60}[shape]
    rows = spark.createDataFrame([*[(float(a), float(b)) for a, b in zip(x, y)], (None, 1.0), (3.0, None), (float("nan"), 2.0)], "x double, y double")
    points = [(v, int((x == v).sum()), float(y[x == v].mean())) for v in np.unique(x)]
    want = sequential(points)
    for blocks in (40, 10_000):
        fitted = isotonic.isotonic_blocks(rows, "x", "y", blocks)
        got = [(r["lo"], r["hi"], r["n"], r["mean"]) for r in fitted.orderBy("lo").collect()]
        assert [g[:3] for g in got] == [tuple(w[:3]) for w in want]
        assert [g[3] for g in got] == pytest.approx([w[3] for w in want])
    asked = spark.createDataFrame([(float(v),) for v in (-5, 0, 0, 17, 17.25, 200.5, 399, 1000)] + [(None,), (float("nan"),)], "x double")
    xs, ys = [v for w in want for v in dict.fromkeys(w[:2])], [w[3] for w in want for _ in dict.fromkeys(w[:2])]
    for r in isotonic.isotonic_apply(asked, fitted, "x", "fit").collect():
        assert r["fit"] == pytest.approx(np.interp(r["x"], xs, ys)) if r["x"] is not None and r["x"] == r["x"] else r["fit"] is None
    assert isotonic.isotonic_apply(asked, isotonic.isotonic_blocks(rows.limit(0), "x", "y"), "x", "fit").filter("fit is not null").count() == 0


def write_book(path, named):
    """An .xlsx file of {sheet: rows}; strings are shared, but for those that begin with '=', which stand in their cell; None is no cell."""
    main, rel = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"', "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    shared = list(dict.fromkeys(v for rows in named.values() for row in rows for v in row if isinstance(v, str) and not v.startswith("=")))

    def cell(ref, v):
        if isinstance(v, bool):
            return f'<c r="{ref}" t="b"><v>{int(v)}</v></c>'
        if isinstance(v, str):
            return f'<c r="{ref}" t="inlineStr"><is><t>{escape(v[1:])}</t></is></c>' if v.startswith("=") else f'<c r="{ref}" t="s"><v>{shared.index(v)}</v></c>'
        return "" if v is None else f'<c r="{ref}"><v>{v!r}</v></c>'

    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("xl/workbook.xml", f'<workbook {main} xmlns:r="{rel}"><sheets>' + "".join(f'<sheet name="{n}" sheetId="{i}" r:id="rId{i}"/>' for i, n in enumerate(named, 1)) + "</sheets></workbook>")
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">' + "".join(f'<Relationship Id="rId{i}" Target="worksheets/sheet{i}.xml"/>' for i in range(1, len(named) + 1)) + "</Relationships>")
        z.writestr("xl/sharedStrings.xml", f"<sst {main}>" + "".join(f"<si><r><t>{escape(s[:1])}</t></r><r><t>{escape(s[1:])}</t></r></si>" for s in shared) + "</sst>")
        for i, rows in enumerate(named.values(), 1):
            body = "".join(f'<row r="{k}">' + "".join(cell(f"{chr(65 + j)}{k}", v) for j, v in enumerate(row)) + "</row>" for k, row in enumerate(rows, 1))
            z.writestr(f"xl/worksheets/sheet{i}.xml", f"<worksheet {main}><sheetData>{body}</sheetData></worksheet>")


def test_spreadsheets(spark, tmp_path):
    rows = [["name", "size", "ok", "n"], ["a & b", 1.5, True, 3], ["=in <place>", None, False, 4], [None, None, None, None], ["ü", -2e-3, None, 12345678901]]
    write_book(tmp_path / "one.xlsx", {"Main": rows, "Other": [["n"], [9]]})
    write_book(tmp_path / "two.xlsx", {"Main": rows[:2], "Other": [["n"]]})
    kinds = "name string, size double, ok boolean, n bigint"
    got = [tuple(r) for r in tables.read_table(spark, str(tmp_path / "one.xlsx"), kinds).collect()]
    assert got == [("a & b", 1.5, True, 3), ("in <place>", None, False, 4), ("ü", -0.002, None, 12345678901)]
    both = sheets.read_sheets(spark, str(tmp_path / "*.xlsx"), "n int", "Other", "file").collect()
    assert [(r["n"], r["file"].rsplit("/", 1)[1]) for r in both] == [(9, "one.xlsx")]
    assert sheets.read_sheets(spark, str(tmp_path), kinds).count() == 4
    out = str(tmp_path / "out.parquet")
    tables.write_table(tables.read_table(spark, str(tmp_path / "one.xlsx"), kinds), out)
    assert sorted(tables.read_table(spark, out).collect(), key=repr) == sorted(tables.read_table(spark, str(tmp_path / "one.xlsx"), kinds).collect(), key=repr)
    assert [sheets.column_of(c) for c in ("A1", "Z9", "AA3", "BC10")] == [0, 25, 26, 54]
    with pytest.raises(ValueError, match="declare"):
        tables.read_table(spark, str(tmp_path / "one.xlsx"))
    for schema, sheet in (("missing string", None), ("n int", "Absent")):
        with pytest.raises(Exception, match="no column|no sheet"):
            sheets.read_sheets(spark, str(tmp_path / "one.xlsx"), schema, sheet).collect()


def test_a_sweep_predicts_equal_rows_once(spark):
    rows = spark.range(3000).select((F.col("id") % 9).cast("double").alias("a"), (F.col("id") % 2).cast("double").alias("u"), F.when(F.col("id") % 7 > 0, F.col("id") % 101 * 0.1).alias("y"))
    met = []

    def predict(df):
        met.append(df.count())
        return df.withColumn("p_y", F.when(F.col("a") <= 3, 2.0).when(F.col("a") <= 6, 5.0).otherwise(8.0) + F.col("u"))

    want, got = (sweeps.sweep_factor(rows, "a", [3.0, 6.0], predict, [("y", "p_y")], low=0.2, high=5.0, reads=reads) for reads in (None, ["a", "u"]))
    assert got == pytest.approx(want, rel=1e-12) and met[1] * 100 < met[0]
