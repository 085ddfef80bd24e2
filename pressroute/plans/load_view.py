"""Load view by mapping: a list of column specifications becomes one projection with typed columns, resolved codes and
the faults of each row."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F


@dataclass(frozen=True)
class Field:
    """One column of the view. Of ``sources`` (raw columns) the first that holds text counts; without one the default does.

    ``kind`` is a Spark type; dates are read by ``pattern``. ``longest`` bounds the text. A ``required`` field needs
    text. ``codes`` names a code table: text that is not one of its codes is a fault, and the code's id follows
    the column as ``<name>_id``.
    """

    name: str
    sources: tuple[str, ...] = ()
    default: str | int | None = ""
    kind: str = "string"
    pattern: str | None = None
    longest: int | None = None
    required: bool = False
    codes: str | None = None


# Columns of the canonical load view in its order, with the default that stands for a column the file lacks.
STANDARD: dict[str, str | int | None] = {
    "drawdate": None, "deliverydate": None, "drawamount": 0, "publication": "", "drawrate": 0,
    "mfstname": "", "mfstcode": "", "mfstdescription": "", "mfstnotes": "", "mfstcustom1": "", "mfstcustom2": "", "mfstcustom3": "", "mfstowner": "",
    "acctname": "", "acctcode": "", "acctdescription": "", "accttype": "UNKN", "acctcategory": "NONE", "acctnotes": "", "acctaddress": "",
    "acctcity": "", "acctstateprovince": "", "acctpostalcode": "", "acctcountry": "", "acctcontact": "", "accthours": "", "acctphone": "",
    "acctcreditcardonfile": "", "acctcustom1": "", "acctcustom2": "", "acctcustom3": "", "acctspecialinstructions": "", "acctrollup": 0,
    "dropname": "", "dropsequence": "", "dropdescription": "", "dropaddress": "", "dropcity": "", "dropstateprovince": "", "dropcountry": "",
    "droppostalcode": "", "dropdeliveryinstructions": "", "acctcorporate": "",
    "deliverystartdate": None, "deliverystopdate": None, "forecaststartdate": None, "forecaststopdate": None,
    "excludefrombilling": 0, "acctpubactive": 1, "apcustom1": "", "apcustom2": "", "apcustom3": "",
    "allowforecasting": 1, "allowreturns": 1, "allowadjustments": 1, "forecastmindraw": 0, "forecastmaxdraw": 2147483647,
}
DATES = {"drawdate", "deliverydate", "deliverystartdate", "deliverystopdate", "forecaststartdate", "forecaststopdate"}


def standard_fields(mapping: dict[str, Field]) -> list[Field]:
    """The canonical view's columns in order: those of the mapping as it says, all others by their default."""
    unknown = sorted(set(mapping) - set(STANDARD))
    if unknown:
        raise ValueError(f"not a column of the load view: {unknown}")

    def lacking(name: str, default) -> Field:
        kind = "date" if name in DATES else "int" if isinstance(default, int) else "string"
        return Field(name, default=default, kind="decimal(8,5)" if name == "drawrate" else kind)

    return [mapping.get(name) or lacking(name, default) for name, default in STANDARD.items()]


def _text(field: Field) -> Column:
    texts = [F.nullif(F.trim(F.col(f"raw.{s}").cast("string")), F.lit("")) for s in field.sources]
    return F.coalesce(*texts) if texts else F.lit(None).cast("string")


def _code_key(code: Column) -> Column:
    """Codes are the same without regard to case and outer blanks."""
    return F.lower(F.trim(code))


def read_by(raw: DataFrame, fields: list[Field], codes: dict[str, DataFrame], keep: list[str] | None = None) -> DataFrame:
    """The ``keep`` columns, the fields, the ids of their codes, and ``faults`` (a list of texts, empty for a good row).

    Text is trimmed and blank text is none. A value that cannot be read is null with a fault. Each code table
    (``code, id``, one row a code) is one left join on the trimmed code in lower case, so that unknown
    codes stay and are told. Everything else is one projection over one scan.
    """
    rows = raw.select(F.struct(*raw.columns).alias("raw"))
    for field in (f for f in fields if f.codes):
        table = codes[field.codes].select(_code_key(F.col("code")).alias(f"__{field.name}"), F.col("id").alias(f"{field.name}_id"))
        rows = rows.withColumn(f"__{field.name}", _code_key(_text(field))).join(table, f"__{field.name}", "left")
    out, faults = [], []
    for field in fields:
        text, default = _text(field), F.lit(field.default).cast(field.kind)
        value = text if field.kind == "string" else F.try_to_timestamp(text, F.lit(field.pattern)).cast("date") if field.pattern else text.try_cast(field.kind)
        if field.sources:
            faults.append(F.when(text.isNotNull() & value.isNull(), F.concat(F.lit(f"{field.name}: cannot read "), text)))
        if field.required:
            faults.append(F.when(text.isNull(), f"{field.name}: missing"))
        if field.longest:
            faults.append(F.when(F.length(text) > field.longest, f"{field.name}: longer than {field.longest}"))
        out.append((F.coalesce(value, F.when(text.isNull(), default)) if field.sources else default).alias(field.name))
        if field.codes:
            out.append(F.col(f"{field.name}_id"))
            faults.append(F.when(text.isNotNull() & F.col(f"{field.name}_id").isNull(), F.concat(F.lit(f"{field.name}: unknown code "), text)))
    told = F.array_compact(F.array(*faults)) if faults else F.array().cast("array<string>")
    return rows.select(*[F.col(f"raw.{k}").alias(k) for k in keep or []], *out, told.alias("faults"))


def write_checked(view: DataFrame, path: str) -> tuple[DataFrame, DataFrame]:
    """(rows to load, rejects with their faults): both from one pass, written under ``rejected=false`` and ``rejected=true``."""
    view.withColumn("rejected", F.size("faults") > 0).write.partitionBy("rejected").parquet(path)
    back = view.sparkSession.read.schema(view.withColumn("rejected", F.lit(True)).schema).option("basePath", path).parquet(path)
    return back.where("not rejected").drop("rejected", "faults"), back.where("rejected").drop("rejected")
