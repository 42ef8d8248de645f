"""Readers for meter files, customer sheets, requests, weather documents, market lists and price pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from gridlight import constants as C
from gridlight.operators import clean as CL

READING_SCHEMA = T.StructType([
    T.StructField("TRANSFORMER_CODE", T.StringType()), T.StructField("TRANSFORMER_LAT", T.DoubleType()), T.StructField("TRANSFORMER_LON", T.DoubleType()),
    T.StructField("ACCOUNT_NO", T.StringType()), T.StructField("CUSTOMER_LAT", T.DoubleType()), T.StructField("CUSTOMER_LON", T.DoubleType()),
    T.StructField("MONTH", T.IntegerType()), T.StructField("YEAR", T.IntegerType()), T.StructField("IMPORT_kWh", T.DoubleType()),
    T.StructField("EXPORT_kWh", T.DoubleType()), T.StructField("NET_CONSUMPTION_kWh", T.DoubleType()), T.StructField("HAS_SOLAR", T.IntegerType()),
    T.StructField("INV_CAPACITY", T.DoubleType()), T.StructField("CAL_TARIFF", T.StringType()), T.StructField("PHASE", T.StringType()),
    T.StructField("DATA_QUALITY", T.StringType()), T.StructField("SOURCE", T.StringType()), T.StructField("DISTANCE_FROM_TF_M", T.DoubleType())])
REQUIRED_READING_COLUMNS = ["ACCOUNT_NO", "YEAR", "MONTH", "NET_CONSUMPTION_kWh", "CUSTOMER_LAT", "CUSTOMER_LON"]

REQUEST_SCHEMA = ("user_id long, latitude double, longitude double, consumption_months map<string,double>, tariff string, phase string, "
                  "has_solar int, household_size int, year int, search_radius_m double")
MARKET_SCHEMA = ("pricing_database map<string,double>, vendors array<struct<Name: string, Location: string, Contact: string, Specialty: string, rating: double, "
                 "pricing: map<string,double>>>, tariffs struct<base_import_tariff: double, export_tariff_under_5kw: double, export_tariff_over_5kw: double, "
                 "discount_rate: double>, last_updated string")


def read_readings(spark: SparkSession, path: str | list[str], fmt: str = "parquet") -> DataFrame:
    """Readings with a fixed schema; bad CSV rows keep their text in ``_corrupt_record``."""
    if fmt == "parquet":
        return CL.require_columns(spark.read.parquet(*([path] if isinstance(path, str) else path)), REQUIRED_READING_COLUMNS)
    schema = T.StructType([*READING_SCHEMA.fields, T.StructField("_corrupt_record", T.StringType())])
    return spark.read.csv(path, schema=schema, header=True, mode="PERMISSIVE", columnNameOfCorruptRecord="_corrupt_record", ignoreLeadingWhiteSpace=True,
                          ignoreTrailingWhiteSpace=True, enforceSchema=False)


def first_numeric_column(raw: DataFrame, candidates: list[str], name: str) -> DataFrame:
    """Adds ``name``: in every file the first of ``candidates`` whose values are all numbers (blanks aside, and not only blanks).

    One aggregate counts values and numbers of all columns per file."""
    if not candidates:
        return raw.withColumn(name, F.lit(None).cast("string"))
    filled = lambda c: F.nullif(F.trim(F.col(f"`{c}`")), F.lit(""))
    counts = raw.groupBy("_path").agg(*[x for i, c in enumerate(candidates) for x in (F.count(filled(c)).alias(f"_n{i}"), F.count(filled(c).try_cast("double")).alias(f"_k{i}"))])
    chosen = F.coalesce(F.lit(None).cast("string"), *[F.when((F.col(f"_n{i}") > 0) & (F.col(f"_n{i}") == F.col(f"_k{i}")), F.lit(c)) for i, c in enumerate(candidates)])
    found = raw.join(counts.select("_path", chosen.alias("_chosen")), "_path", "left")
    value = F.coalesce(F.lit(None).cast("string"), *[F.when(F.col("_chosen") == c, F.col(f"`{c}`")) for c in candidates])
    return found.withColumn(name, value).drop("_chosen")


def _with_own_headers(spark: SparkSession, paths: str | list[str], wanted: dict[str, tuple[list[str], object]], by_content: str | None = None) -> tuple[DataFrame, list[str]]:
    """CSV files of any column order, each resolved by its own header, and the files that have no readable one.

    Files are grouped by their first line: one read for each different header, however many files share it.  Where no
    header fits the column ``by_content``, the first numeric column that is none of the others stands for it.
    """
    lines = spark.read.text(paths).where(F.trim("value") != "").select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("at"),
                                                                       F.monotonically_increasing_id().alias("line"), "value")
    firsts = lines.where("at = 0").groupBy("path").agg(F.min_by("value", "line").alias("header"))
    groups = {r.header: sorted(r.paths) for r in firsts.groupBy("header").agg(F.collect_list("path").alias("paths")).collect()}    # as long as the list of files
    parts, bad = [], []
    for header, files in sorted(groups.items()):
        raw = spark.read.option("ignoreMissingFiles", "true").csv(files, header=True, ignoreLeadingWhiteSpace=True, ignoreTrailingWhiteSpace=True)
        raw = CL.strip_headers(raw.withColumn("_path", F.col("_metadata.file_path")))
        fits = lambda c, words: all(w.lower() in c.lower() for w in words)
        if not any(fits(c, wanted["ACCOUNT_NO"][0]) for c in raw.columns):
            bad += files
            continue
        if by_content and not any(fits(c, wanted[by_content][0]) for c in raw.columns):
            others = [c for c in raw.columns if c != "_path" and not any(fits(c, words) for words, _ in wanted.values())]
            raw = first_numeric_column(raw, others, by_content)
            parts.append(CL.resolve_columns(raw, {k: ([k], d) if k == by_content else (w, d) for k, (w, d) in wanted.items()} | {"_path": (["_path"], None)}))
            continue
        parts.append(CL.resolve_columns(raw, wanted | {"_path": (["_path"], None)}))
    if not parts:
        return spark.createDataFrame([], T.StructType([T.StructField(c, T.StringType()) for c in [*wanted, "_path"]])), bad
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part, allowMissingColumns=True)
    return out, bad


def read_customer_sheets(spark: SparkSession, folder: str, files: str = "*.csv", code: str = r"([^/]*)\.csv$") -> DataFrame:
    """Customer master from CSV sheets, each with its own header; ``code`` finds the transformer in the path, by default the file name.

    A sheet without a capacity column takes its first numeric column that is not known for something else, and 0 if there is none.
    A sheet without an account column gives one row with its transformer, nulls and ``problem`` set."""
    out, bad = _with_own_headers(spark, f"{folder}/{files}", {"ACCOUNT_NO": (["account"], None), "INV_CAPACITY": (["inv", "capacity"], "0"),
                                                              "CAL_TARIFF": (["tariff"], C.DEFAULT_TARIFF), "PHASE": (["phase"], "SP")}, by_content="INV_CAPACITY")
    out = CL.coerce_numeric(CL.trim_strings(out), ["INV_CAPACITY"]).fillna({"INV_CAPACITY": 0.0, "CAL_TARIFF": C.DEFAULT_TARIFF, "PHASE": "SP"})
    out = out.withColumns({"HAS_SOLAR": (F.col("INV_CAPACITY") > 0).cast("int"), "problem": F.lit(None).cast("string")})
    lost = spark.createDataFrame([(p, "no account column") for p in bad], "_path string, problem string")
    out = out.unionByName(lost, allowMissingColumns=True)
    return out.withColumn("TRANSFORMER_CODE", F.regexp_extract("_path", code, 1)).drop("_path")


def read_month_files(spark: SparkSession, manifest: DataFrame, paths: list[str]) -> DataFrame:
    """Monthly meter files, each with its own header; ``manifest`` names (path, TRANSFORMER_CODE, MONTH, YEAR).

    Files are told apart by their whole path.  A file without an account column gives one row with null readings and
    ``problem`` set, so that nothing is skipped in silence.
    """
    out, bad = _with_own_headers(spark, paths, {"ACCOUNT_NO": (["account"], None), "IMPORT_kWh": (["import", "total"], None), "EXPORT_kWh": (["export", "total"], "0")})
    out = CL.coerce_numeric(CL.trim_strings(out), ["IMPORT_kWh", "EXPORT_kWh"]).withColumn("problem", F.lit(None).cast("string"))
    lost = spark.createDataFrame([(p, "no account column") for p in bad], "_path string, problem string")
    out = out.unionByName(lost, allowMissingColumns=True)
    plain = lambda c: F.regexp_replace(c, "^[a-z]+:/+", "/")
    named = manifest.withColumn("_plain", plain(F.col("path"))).drop("path")
    return out.withColumn("_plain", plain(F.col("_path"))).join(named, "_plain").drop("_plain", "_path")


def attach_customers(readings: DataFrame, master: DataFrame) -> DataFrame:
    """Readings with the first master row of their (transformer, account); defaults where there is none."""
    key = F.struct("INV_CAPACITY", "CAL_TARIFF", "PHASE")
    once = master.groupBy("TRANSFORMER_CODE", "ACCOUNT_NO").agg(F.min_by(F.struct("HAS_SOLAR", "INV_CAPACITY", "CAL_TARIFF", "PHASE"), key).alias("m"))
    df = readings.join(once, ["TRANSFORMER_CODE", "ACCOUNT_NO"], "left")
    return df.withColumns({"HAS_SOLAR": F.coalesce("m.HAS_SOLAR", F.lit(0)), "INV_CAPACITY": F.coalesce("m.INV_CAPACITY", F.lit(0.0)),
                           "CAL_TARIFF": F.coalesce("m.CAL_TARIFF", F.lit(C.DEFAULT_TARIFF)), "PHASE": F.coalesce("m.PHASE", F.lit("SP"))}).drop("m")


# ---- requests -----------------------------------------------------------------------

def read_requests(spark: SparkSession, path: str) -> DataFrame:
    raw = spark.read.schema(REQUEST_SCHEMA).json(path)
    return raw.withColumn("consumption_months", month_keys(F.col("consumption_months")))


def _month_map(entries: Column) -> Column:
    """(k, v) entries to a map; entries without a month or value are left out, of one month the last counts."""
    good = F.filter(entries, lambda e: e["k"].isNotNull() & e["v"].isNotNull())
    last = lambda e, i: ~F.exists(F.slice(good, i + 2, F.greatest(F.size(good) - i - 1, F.lit(0))), lambda x: x["k"] == e["k"])
    return F.map_from_entries(F.filter(good, last))


def month_keys(m: Column) -> Column:
    """Keys ``"9"`` or ``"9:2025"`` to month numbers; unparsable entries are left out, of one month the last counts."""
    return _month_map(F.transform(F.map_entries(m), lambda e: F.struct(F.trim(F.split(e["key"], ":")[0]).try_cast("int").alias("k"), e["value"].try_cast("double").alias("v"))))


def parse_month_text(text: Column) -> Column:
    """``"9:350.5,10:420.2"`` to a map of month to kWh; entries that do not parse are left out, of one month the last counts."""
    return _month_map(F.transform(F.split(text, ","), lambda p: F.struct(F.trim(F.get(F.split(p, ":"), 0)).try_cast("int").alias("k"), F.trim(F.get(F.split(p, ":"), 1)).try_cast("double").alias("v"))))


# ---- weather documents ----------------------------------------------------------------

WEATHER_JSON = "properties struct<parameter: map<string, map<string, double>>>"


def _parameters(docs: DataFrame, json_col: str, keys: list[str]) -> DataFrame:
    doc = F.from_json(F.col(json_col), WEATHER_JSON)
    rows = docs.select(*keys, F.explode(doc["properties"]["parameter"]).alias("parameter", "series"))
    rows = rows.select(*keys, "parameter", F.explode("series").alias("period", "value"))
    return rows.withColumn("value", F.when(F.col("value") > C.SENTINEL_LIMIT, F.col("value")))


def _wide(rows: DataFrame, keys: list[str], parameters: dict[str, str]) -> DataFrame:
    """One column per parameter from a fixed list, so the pivot needs no extra pass."""
    return rows.groupBy(*keys).agg(*[F.max(F.when(F.col("parameter") == p, F.col("value"))).alias(c) for p, c in parameters.items()])


def monthly_weather(docs: DataFrame, json_col: str, keys: list[str], parameters: dict[str, str] = C.WEATHER_PARAMETERS, year: int | None = None) -> DataFrame:
    """Monthly documents (periods ``YYYYMM``; month 13 is the yearly mean) to one row per year and month."""
    rows = _parameters(docs, json_col, keys).where(F.col("period").rlike(r"^\d{4}(0[1-9]|1[0-2])$"))
    rows = rows.withColumns({"Year": F.substring("period", 1, 4).cast("int"), "Month": F.substring("period", 5, 2).cast("int")})
    if year is not None:
        rows = rows.where(F.col("Year") == year)
    return _wide(rows, [*keys, "Year", "Month"], parameters)


def climatology_weather(docs: DataFrame, json_col: str, keys: list[str], parameters: dict[str, str] = C.WEATHER_PARAMETERS) -> DataFrame:
    """Typical-year documents (periods ``JAN``..``DEC``) to twelve rows per key."""
    names = F.array(*[F.lit(k) for k in C.CLIMATOLOGY_KEYS])
    rows = _parameters(docs, json_col, keys).withColumn("Month", F.array_position(names, F.col("period")).cast("int")).where("Month > 0")
    return _wide(rows, [*keys, "Month"], parameters)


def cached_weather(cache: DataFrame, now: Column, ttl_days: int = 30) -> DataFrame:
    """Newest live entry per (latitude, longitude, year) of a landed cache table."""
    live = cache.where(F.col("ingested_at") >= now - F.make_dt_interval(F.lit(ttl_days)))
    key = [F.round("latitude", 4).alias("latitude"), F.round("longitude", 4).alias("longitude"), F.col("year")]
    return live.groupBy(*key).agg(F.max_by("document", "ingested_at").alias("document"), F.max("ingested_at").alias("ingested_at"))


# ---- market -----------------------------------------------------------------------------

def read_market(spark: SparkSession, path: str | None) -> dict[str, DataFrame]:
    """Price list, vendor price points and tariffs of a market document; defaults without one."""
    if path is None:
        prices = F.array(*[F.struct(F.lit(float(k)).alias("size_kw"), F.lit(float(v)).alias("price_lkr")) for k, v in C.DEFAULT_PRICES.items()])
        one = spark.range(1)
        return {"prices": one.select(F.inline(prices)),
                "vendors": one.select(F.lit("System Default Vendor").alias("vendor"), F.lit(None).cast("double").alias("size_kw"), F.lit(None).cast("double").alias("price_lkr")),
                "tariffs": one.select(F.lit(C.BASE_IMPORT_TARIFF).alias("base_import_tariff"), F.lit(C.EXPORT_TARIFF_UNDER_5).alias("export_tariff_under_5kw"),
                                      F.lit(C.EXPORT_TARIFF_OVER_5).alias("export_tariff_over_5kw"), F.lit(C.DISCOUNT_RATE).alias("discount_rate"))}
    doc = spark.read.schema(MARKET_SCHEMA).json(path, multiLine=True)
    points = doc.select(F.explode("vendors").alias("v")).select(F.col("v.Name").alias("vendor"), "v.rating", F.explode("v.pricing").alias("k", "price_lkr"))
    return {"prices": doc.select(F.explode("pricing_database").alias("k", "price_lkr")).select(F.col("k").cast("double").alias("size_kw"), "price_lkr"),
            "vendors": points.select("vendor", "rating", F.col("k").cast("double").alias("size_kw"), "price_lkr"),
            "tariffs": doc.select("tariffs.*")}


def _digits(text: Column) -> Column:
    only = F.regexp_replace(text, r"\D", "")
    return F.when(F.length(only).between(1, 15), only.cast("long"))


def vendor_page_prices(pages: DataFrame, sizes: list[int] = C.PRICE_SIZES) -> DataFrame:
    """Prices per system size found in whole landed pages: (page_id, size_kw, rule, price_lkr).

    Rules: the price node of a product page whose address names the size; "<size>kW ...
    starting from Rs. n"; "<size>kW system ... LKR a - b" (averaged), on one line.  Prices outside the sanity limits are dropped.

    One pattern finds all sizes, prices and line ends of a text in their order; a fold over this short list then
    tells for each size what follows its first mention, so the text is not searched again for every size.
    """
    url_size = F.regexp_extract(F.lower("url"), r"/(\d+)kw-", 1)
    node = F.when(url_size != "", F.regexp_replace(F.regexp_extract("html", C.PRICE_NODE, 1), C.PAGE_TAG, " "))
    df = pages.select("page_id", url_size.alias("url_size"), node.alias("node"), F.regexp_extract_all(F.regexp_replace("html", C.PAGE_TAG, " "), F.lit(C.PRICE_EVENT), F.lit(0)).alias("events"))

    def follow(steps: list, restart=None) -> Column:
        """The event at which the last of ``steps`` is met, each after the one before; ``restart`` begins anew."""
        def turn(a, e):
            out = F.when(a["stage"] == len(steps), a)
            if restart is not None:
                out = out.when(restart(e), F.struct(F.lit(0).alias("stage"), F.lit(None).cast("string").alias("hit")))
            for i, met in enumerate(steps):
                out = out.when((a["stage"] == i) & met(e), F.struct(F.lit(i + 1).alias("stage"), e.alias("hit")))
            return out.otherwise(a)
        start = F.struct(F.lit(0).alias("stage"), F.lit(None).cast("string").alias("hit"))
        return F.aggregate("events", start, turn, lambda a: F.when(a["stage"] == len(steps), a["hit"]))

    begins = lambda word: lambda e: F.lower(e).startswith(word)
    found = []
    for s in sizes:
        start = follow([begins(f"{s}kw"), begins("starting from"), begins("rs")])
        band = follow([lambda e, s=s: F.lower(e) == f"{s}kw system", begins("lkr")], restart=lambda e: e.rlike("^[\\n\\r\u0085\u2028\u2029]"))
        lo, hi = (_digits(F.regexp_extract(band, r"([\d,]+)\s*[-–]\s*([\d,]+)", i)) for i in (1, 2))
        named = F.when(F.col("url_size") == str(s), _digits(F.split("node", r"\.")[0]))
        for rule, price in (("price_node", named), ("starting_from", _digits(start)), ("price_range", F.floor((lo + hi) / 2))):
            found.append(F.struct(F.lit(s).alias("size_kw"), F.lit(rule).alias("rule"), price.alias("price_lkr")))
    rows = df.select("page_id", F.inline(F.array(*found)))
    return rows.where((F.col("price_lkr") > C.PRICE_FLOOR) & (F.col("price_lkr") < C.PRICE_CEILING))


def discount_rate(docs: DataFrame, json_col: str, keys: list[str]) -> DataFrame:
    """Latest known inflation of a response document, turned into a discount rate."""
    doc = F.from_json(F.get_json_object(json_col, "$[1]"), "array<struct<date: string, value: double>>")
    rows = docs.select(*keys, F.explode(doc).alias("e")).where(F.col("e.value").isNotNull())
    return rows.groupBy(*keys).agg(F.max_by(F.col("e.value"), F.col("e.date").cast("int")).alias("inflation_pct")) \
        .withColumn("discount_rate", F.round(F.col("inflation_pct") / 100 + 1e-9, 3) + 0.045)
