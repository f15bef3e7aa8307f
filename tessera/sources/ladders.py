"""Manifest and catalog: external labels and groups, file names, file resolution, the measurement catalog, sheets."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators.shaping import label_precedence

LABELS = ("LB", "MEI", "UNK")
GROUPS = ("Ctrl", "Exp", "UNK")
KEYS = ["fecha", "lab", "mid", "archivo", "color", "filename_expected"]
#: Steps of the ladder up to this one are exact names; later ones count only if a single file of the folder fits.
EXACT = 5


def text_of(rows: DataFrame, column: str, default: str = "") -> Column:
    """A column as trimmed text; the default where the column is absent, null or blank."""
    return F.coalesce(F.nullif(F.trim(F.col(column).cast("string")), F.lit("")), F.lit(default)) if column in rows.columns else F.lit(default)


def external_keys(rows: DataFrame, value: str, allowed: Sequence[str], keys: Sequence[str], scope: Sequence[str] = (), order: str = "row_no") -> DataFrame:
    """H1: scope, keys, label and row_no, one row for each filled key of each row, the other keys null; made for ``label_precedence``.

    Blank keys are skipped. A missing value column, no key column at all or a value that is not allowed raises ValueError.
    """
    own = [k for k in keys if k in rows.columns]
    if value not in rows.columns or not own:
        raise ValueError(f"needs column {value} and one of {', '.join(keys)}")
    label = text_of(rows, value)
    wrong = rows.where(~label.isin(list(allowed))).select(label).first()
    if wrong:
        raise ValueError(f"{value} {wrong[0]!r} is not one of {', '.join(allowed)}")
    filled = {c: F.nullif(text_of(rows, c), F.lit("")) for c in (*scope, *keys)}
    each = [F.struct(*[(filled[c] if c == k else F.lit(None).cast("string")).alias(c) for c in keys]) for k in own]
    flat = rows.select(*[filled[c].alias(c) for c in scope], label.alias("label"), F.col(order).alias("row_no"), F.explode(F.array(*each)).alias("k"))
    return flat.select(*scope, "k.*", "label", "row_no").where(F.coalesce(*keys).isNotNull())


def expected_name(mid: Column, archivo: Column, color: Column, blind: bool) -> Column:
    """H2: the measurement's name if blind or if index or colour is unknown, else index, med and colour."""
    plain = F.concat(mid, F.lit(".csv"))
    if blind:
        return plain
    declared = F.concat(archivo.cast("string"), F.lit("med"), color, F.lit(".csv"))
    return F.when((archivo >= 0) & (color != "") & (F.upper(color) != "UNK"), declared).otherwise(plain)


def resolve_files(manifest: DataFrame, listing: DataFrame, strict: bool = False) -> DataFrame:
    """Manifest with found_name, found_path and resolve_tag (expected, compat_found, missing, missing_dir).

    manifest has KEYS; listing has fecha, lab, name, path. First of: the expected name, the measurement's name, the index padded to
    two or three digits with the colour as it is or in lower case, the only CSV that starts with index and med, the only CSV that
    starts with that number. Every step is a key, so that files and manifest meet in one equi-join and no folder's pairs are made; the
    files are counted by key before. A folder without files counts as missing. Strict takes the first step only.
    """
    listing = listing.dropDuplicates(["fecha", "lab", "name"])
    low = F.lower("name")
    csv = F.when(low.endswith(".csv"), low)
    number = F.regexp_extract(csv, r"^(\d{1,9})", 1)
    opened = F.nullif(F.regexp_extract(csv, r"^(\d+)med", 1), F.lit(""))
    keys = F.array(F.concat(F.lit("n:"), "name"), F.concat(F.lit("p:"), opened), F.concat(F.lit("d:"), F.nullif(number, F.lit("")).cast("int").cast("string")))
    files = listing.select("fecha", "lab", "name", "path", F.explode(keys).alias("key")).where("key is not null")
    files = files.groupBy("fecha", "lab", "key").agg(F.count("*").alias("n"), F.min("name").alias("found_name"), F.min("path").alias("found_path"))

    index, color = F.col("archivo").cast("string"), F.col("color")
    known = (F.col("archivo") >= 0) & (color != "") & (F.upper(color) != "UNK")
    padded = [F.when(known, F.concat(F.lit("n:"), F.lpad(index, F.greatest(F.lit(w), F.length(index)), F.lit("0")), F.lit("med"), c, F.lit(".csv"))) for c in (color, F.lower(color)) for w in (2, 3)]
    near = [F.when(F.col("archivo") >= 0, F.concat(F.lit(p), index)) for p in ("p:", "d:")]
    ladder = [F.concat(F.lit("n:"), "filename_expected")] + ([] if strict else [F.concat(F.lit("n:"), "mid", F.lit(".csv")), *padded, *near])
    wanted = manifest.select(KEYS).distinct().select(*KEYS, F.posexplode(F.array(*ladder)).alias("step", "key"))
    found = wanted.join(files, ["fecha", "lab", "key"]).where(f"step <= {EXACT} or n = 1")
    found = found.groupBy(KEYS).agg(F.min("step").alias("step"), F.min_by("found_name", "step").alias("found_name"), F.min_by("found_path", "step").alias("found_path"))
    folders = listing.select("fecha", "lab", F.lit(True).alias("__folder")).distinct()
    rows = manifest.join(found, KEYS, "left").join(folders, ["fecha", "lab"], "left")
    tag = F.when(F.col("step") == 0, "expected").when(F.col("step") > 0, "compat_found")
    tag = tag.when(F.col("__folder").isNull() & F.lit(not strict), "missing_dir").otherwise("missing")
    return rows.withColumn("resolve_tag", tag).drop("step", "__folder")


def build_catalog(manifest: DataFrame, listing: DataFrame, labels: DataFrame, groups: DataFrame, *, root: str, target: str = "", blind: bool = True, strict: bool = False, folder: str = "Raw Data") -> DataFrame:
    """A row for each manifest row with ids, names, file and the labels and groups of today; those of the manifest are kept beside.

    labels and groups are results of ``external_keys``: labels by mid, canonical_name (rows with a lab are left out here), groups by
    fecha, mid, canonical_name. A row without file keeps the path that was expected.
    """
    missing = [c for c in ("fecha", "lab", "archivo") if c not in manifest.columns]
    if missing:
        raise ValueError(f"manifest lacks {', '.join(missing)}")
    rows = manifest.select(
        text_of(manifest, "fecha").alias("fecha"), text_of(manifest, "lab").alias("lab"), text_of(manifest, "turno").alias("turno"), text_of(manifest, "color", "UNK").alias("color"),
        F.coalesce(F.expr("try_cast(archivo as double)").cast("int"), F.lit(-1)).alias("archivo"), text_of(manifest, "jornada", "UNK").alias("jornada_manifest"), text_of(manifest, "etiqueta", "UNK").alias("etiqueta_manifest"),
    )
    rows = rows.withColumn("mid", S.mid(F.col("fecha"), F.col("lab"), F.col("archivo")))
    rows = rows.withColumn("filename_expected", expected_name(F.col("mid"), F.col("archivo"), F.col("color"), blind))
    rows = resolve_files(rows, listing, strict)
    wanted = F.concat_ws("/", F.lit(root.rstrip("/")), "fecha", "lab", F.lit(folder), "filename_expected")
    rows = rows.withColumns({"raw_exists": F.col("found_path").isNotNull(), "raw_path": F.coalesce("found_path", wanted), "canonical_name": F.coalesce("found_name", "filename_expected")})
    labels = labels.where("lab is null").drop("lab") if "lab" in labels.columns else labels
    rows = label_precedence(rows, labels, [["mid"], ["canonical_name"]]).withColumnRenamed("label", "etiqueta")
    rows = label_precedence(rows, groups, [["fecha"], ["mid"], ["canonical_name"]]).withColumnRenamed("label", "jornada")
    relative = S.relative_path(F.col("raw_path"), target) if target else F.col("raw_path")
    return rows.select("mid", "fecha", "jornada", "lab", "turno", "archivo", "color", "etiqueta", "filename_expected", "canonical_name", "raw_path", "raw_exists", "resolve_tag", relative.alias("relpath"), "jornada_manifest", "etiqueta_manifest")


def sheets(books: Mapping[str, DataFrame], order: str) -> dict[str, DataFrame]:
    """Relations of sheets whose first row, by order, holds the headers; the headers trimmed with spaces as underscores, columns headed ``Unnamed`` gone.

    Sheets come as Parquet or CSV (no spreadsheet reader is at hand). Only the header row of each sheet reaches the driver.
    """
    out = {}
    for name, raw in books.items():
        head = raw.orderBy(order).first()
        cells = [c for c in raw.columns if c != order]
        heads = {c: "nan" if head is None or head[c] is None else str(head[c]).strip().replace(" ", "_") for c in cells}
        rest = raw if head is None else raw.where(F.col(order) > F.lit(head[order]))
        out[name] = rest.select(*[F.col(c).alias(h) for c, h in heads.items() if not h.startswith("Unnamed")])
    return out
