"""Reference ranges, unit conversion and the out-of-range flag."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions.text import norm_text
from .trends import finite, latest_usable_range

ADULT_AGE = 18

# Unit, dimension, factor to the base unit of the dimension, offset added before the factor.
UNITS = [
    ("kg", "mass", 1000.0, 0.0), ("g", "mass", 1.0, 0.0), ("mg", "mass", 1e-3, 0.0), ("ug", "mass", 1e-6, 0.0), ("ng", "mass", 1e-9, 0.0),
    ("[lb_av]", "mass", 453.59237, 0.0), ("[oz_av]", "mass", 28.349523125, 0.0),
    ("m", "length", 1.0, 0.0), ("cm", "length", 0.01, 0.0), ("mm", "length", 0.001, 0.0), ("[in_i]", "length", 0.0254, 0.0), ("[ft_i]", "length", 0.3048, 0.0),
    ("L", "volume", 1.0, 0.0), ("dL", "volume", 0.1, 0.0), ("mL", "volume", 1e-3, 0.0), ("uL", "volume", 1e-6, 0.0), ("fL", "volume", 1e-15, 0.0),
    ("K", "temperature", 1.0, 0.0), ("Cel", "temperature", 1.0, 273.15), ("[degF]", "temperature", 5.0 / 9.0, 459.67),
    ("mol", "amount", 1.0, 0.0), ("mmol", "amount", 1e-3, 0.0), ("umol", "amount", 1e-6, 0.0),
    ("g/L", "mass_concentration", 1.0, 0.0), ("g/dL", "mass_concentration", 10.0, 0.0), ("g/mL", "mass_concentration", 1000.0, 0.0),
    ("mg/dL", "mass_concentration", 0.01, 0.0), ("mg/L", "mass_concentration", 1e-3, 0.0), ("mg/mL", "mass_concentration", 1.0, 0.0),
    ("ug/dL", "mass_concentration", 1e-5, 0.0), ("ug/L", "mass_concentration", 1e-6, 0.0), ("ug/mL", "mass_concentration", 1e-3, 0.0),
    ("ng/mL", "mass_concentration", 1e-6, 0.0), ("ng/dL", "mass_concentration", 1e-8, 0.0), ("ng/L", "mass_concentration", 1e-9, 0.0), ("pg/mL", "mass_concentration", 1e-9, 0.0),
    ("mol/L", "amount_concentration", 1.0, 0.0), ("mmol/L", "amount_concentration", 1e-3, 0.0), ("umol/L", "amount_concentration", 1e-6, 0.0),
    ("nmol/L", "amount_concentration", 1e-9, 0.0), ("pmol/L", "amount_concentration", 1e-12, 0.0),
    ("U/L", "activity", 1.0, 0.0), ("U/mL", "activity", 1000.0, 0.0), ("mU/L", "activity", 1e-3, 0.0),
    ("[IU]/L", "arbitrary", 1.0, 0.0), ("[IU]/mL", "arbitrary", 1000.0, 0.0), ("m[IU]/L", "arbitrary", 1e-3, 0.0), ("u[IU]/mL", "arbitrary", 1e-3, 0.0),
    ("/L", "number_concentration", 1.0, 0.0), ("/uL", "number_concentration", 1e6, 0.0), ("10*3/uL", "number_concentration", 1e9, 0.0),
    ("10*6/uL", "number_concentration", 1e12, 0.0), ("10*9/L", "number_concentration", 1e9, 0.0), ("10*12/L", "number_concentration", 1e12, 0.0),
    ("1", "fraction", 1.0, 0.0), ("%", "fraction", 0.01, 0.0),
    ("mm[Hg]", "pressure", 133.322387415, 0.0), ("kPa", "pressure", 1000.0, 0.0), ("Pa", "pressure", 1.0, 0.0),
    ("s", "time", 1.0, 0.0), ("min", "time", 60.0, 0.0), ("h", "time", 3600.0, 0.0), ("d", "time", 86400.0, 0.0),
    ("/s", "rate", 1.0, 0.0), ("/min", "rate", 1.0 / 60.0, 0.0), ("{beats}/min", "rate", 1.0 / 60.0, 0.0),
]
MOLAR_PAIRS = [("mass", "amount"), ("mass_concentration", "amount_concentration")]


def unit_table(spark: SparkSession) -> DataFrame:
    """The fixed unit table; its size is the length of ``UNITS``, so it can be broadcast."""
    return spark.createDataFrame(UNITS, "unit string, dimension string, factor double, offset double")


def _attach(df: DataFrame, units: DataFrame, unit: str, prefix: str) -> DataFrame:
    side = units.select(F.col("unit").alias(unit), F.col("dimension").alias(f"_{prefix}_dim"), F.col("factor").alias(f"_{prefix}_factor"), F.col("offset").alias(f"_{prefix}_offset"))
    return df.join(F.broadcast(side), unit, "left")


def convert_units(df: DataFrame, value: str, from_unit: str, to_unit: str, out: str, molecular_weight: str | None = None) -> DataFrame:
    """``value`` in ``to_unit``: factor and offset inside a dimension, molar mass between mass and amount, else null."""
    units = unit_table(df.sparkSession)
    rows = _attach(_attach(df, units, from_unit, "f"), units, to_unit, "t")
    base = (F.col(value) + F.col("_f_offset")) * F.col("_f_factor")
    back = lambda b: b / F.col("_t_factor") - F.col("_t_offset")
    given = (F.nullif(F.col(from_unit), F.lit("")).isNotNull()) & (F.nullif(F.col(to_unit), F.lit("")).isNotNull())
    result = F.when(given & (F.col(from_unit) == F.col(to_unit)), F.col(value)).when(F.col("_f_dim") == F.col("_t_dim"), back(base))
    if molecular_weight:
        mw = F.col(molecular_weight)
        for mass, amount in MOLAR_PAIRS:
            result = result.when((F.col("_f_dim") == mass) & (F.col("_t_dim") == amount) & (mw > 0), back(base / mw))
            result = result.when((F.col("_f_dim") == amount) & (F.col("_t_dim") == mass) & (mw > 0), back(base * mw))
    made = rows.withColumn(out, F.when(finite(result), result))
    return made.drop(*[f"_{p}_{c}" for p in "ft" for c in ("dim", "factor", "offset")])


def in_range(df: DataFrame, value: str = "value", unit: str = "unit", low: str = "low", high: str = "high", range_unit: str = "range_unit", molecular_weight: str | None = None) -> DataFrame:
    """Add ``in_range``: true, false, or null where the units cannot be compared."""
    plain = lambda c: F.lower(F.trim(F.coalesce(F.col(c), F.lit(""))))
    same = plain(unit) == plain(range_unit)
    conv = convert_units(df, value, unit, range_unit, "_converted", molecular_weight)
    test = lambda v: (v >= F.col(low)) & (v <= F.col(high))
    return conv.withColumn("in_range", F.when(same, test(F.col(value))).when(F.col("_converted").isNotNull(), test(F.col("_converted")))).drop("_converted")


def out_of_range_groups(df: DataFrame, keys: list[str]) -> DataFrame:
    """True if any value is outside, else null if any is inconclusive, else false. Non-finite values do not count."""
    usable = finite(F.col("value"))
    agg = df.groupBy(*keys).agg(
        F.count_if(usable & ~F.col("in_range")).alias("_out"), F.count_if(usable & F.col("in_range").isNull()).alias("_open")
    )
    return agg.select(*keys, F.when(F.col("_out") > 0, True).when(F.col("_open") > 0, F.lit(None).cast("boolean")).otherwise(False).alias("out_of_range"))


def range_codes(ranges: DataFrame) -> DataFrame:
    """``(code, range_id)`` with primary codes before alternates and the earlier definition first."""
    own = ranges.select("code", "range_id", F.lit(0).alias("_alt"))
    alt = ranges.select(F.explode("alternate_codes").alias("code"), "range_id", F.lit(1).alias("_alt"))
    return own.unionByName(alt).groupBy("code").agg(F.min(F.struct("_alt", "range_id"))["range_id"].alias("range_id"))


def range_names(ranges: DataFrame) -> DataFrame:
    names = ranges.select("range_id", F.explode(F.concat(F.array("name"), "aliases")).alias("_name"))
    return names.select(norm_text(F.col("_name")).alias("name_key"), "range_id").filter("name_key <> ''").groupBy("name_key").agg(F.min("range_id").alias("range_id"))


def sex_bound(ranges: DataFrame, sex: Column) -> Column:
    """STRUCT<low, high> for a sex; sex-specific tables give nothing for another or unknown sex."""
    return F.coalesce(F.when(sex == "male", F.col("male")), F.when(sex == "female", F.col("female")), F.col("default"))


def group_ranges(groups: DataFrame, observations: DataFrame, codes: DataFrame, ranges: DataFrame, patients: DataFrame) -> DataFrame:
    """Reference range per group.

    ``groups(patient_id, group_id, name, canonical_system, canonical_code)``,
    ``observations(patient_id, group_id, date, input_pos, low, high, unit, ucum_code, text)``,
    ``codes(patient_id, group_id, code, code_pos)`` the LOINC codes of members in order,
    ``ranges(range_id, code, alternate_codes, name, aliases, unit, molecular_weight, male, female, default)``,
    ``patients(patient_id, sex, age)``. A range of the records themselves wins, then a code of the table, then a name.
    """
    k = ["patient_id", "group_id"]
    adults = patients.filter(F.col("age") >= ADULT_AGE).select("patient_id", "sex")
    g = groups.join(adults, "patient_id")
    own = latest_usable_range(observations, k).select(*k, F.struct("low", "high", "unit", F.lit("resource").alias("source"), F.lit(None).cast("double").alias("molecular_weight"), "text").alias("_own"))
    first = g.filter("canonical_system = 'loinc' and canonical_code is not null").select(*k, F.col("canonical_code").alias("code"), F.lit(-1).cast("bigint").alias("code_pos"))
    offered = first.unionByName(codes.select(*k, "code", F.col("code_pos").cast("bigint").alias("code_pos")))
    by_code = offered.join(range_codes(ranges), "code").groupBy(*k).agg(F.min_by("range_id", "code_pos").alias("_by_code"))
    by_name = g.select(*k, norm_text(F.col("name")).alias("name_key")).join(range_names(ranges), "name_key").select(*k, F.col("range_id").alias("_by_name"))
    chosen = g.join(own, k, "left").join(by_code, k, "left").join(by_name, k, "left").withColumn("range_id", F.coalesce("_by_code", "_by_name"))
    table = ranges.select("range_id", F.col("unit").alias("_unit"), "molecular_weight", "male", "female", "default")
    rows = chosen.join(table, "range_id", "left").withColumn("_bound", sex_bound(ranges, F.col("sex")))
    listed = F.when(
        F.col("_bound").isNotNull(),
        F.struct(F.col("_bound.low").alias("low"), F.col("_bound.high").alias("high"), F.col("_unit").alias("unit"), F.lit("table").alias("source"), "molecular_weight", F.lit(None).cast("string").alias("text")),
    )
    return rows.withColumn("_range", F.coalesce("_own", listed)).filter("_range is not null").select(*k, "_range.*")
