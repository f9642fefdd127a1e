"""Search, listing, facets and the figures of the screen."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from acervo.functions.scoring import matched_terms
from acervo.functions.text import normalized, sqlite_like
from acervo.plans.schemas import LISTED

# The labels of the screen's facets and the categories they stand for.
FACETS = (("Contas", ("conta_luz", "conta_agua")), ("Notas fiscais", ("nota_fiscal",)), ("Comprovantes", ("comprovante",)), ("Contratos", ("contrato",)), ("A revisar", ("outros",)))
ALL = "Todos"


def limited(df: DataFrame, limit: int) -> DataFrame:
    """The first rows; a negative limit is none."""
    return df if limit < 0 else df.limit(limit)


def search(index: DataFrame, term: str, limit: int = 20) -> DataFrame:
    """Rows with the term in name, category, date or text, the latest dates first."""
    pattern = f"%{term}%"
    hit = F.lit(False)
    for c in ("arquivo", "categoria", "data_documento", "texto"):
        hit = hit | sqlite_like(F.col(c), pattern)
    return limited(index.where(hit).orderBy(F.desc_nulls_last("data_documento"), F.desc("id")).select(*LISTED), limit)


def listing(index: DataFrame, limit: int = 50) -> DataFrame:
    """The rows indexed last."""
    return limited(index.select(*LISTED).orderBy(F.desc("id")), limit)


def facet(category: Column) -> Column:
    """The label of a category; null for those that only ``Todos`` shows."""
    out = F.lit(None).cast("string")
    for label, own in FACETS:
        out = F.when(category.isin(*own), label).otherwise(out)
    return out


def facet_counts(index: DataFrame) -> DataFrame:
    """``nome``, ``contagem`` of all rows and of each label: one aggregation by category, then a handful of rows."""
    by = index.groupBy("categoria").agg(F.count("*").alias("n"))
    labels = F.array_compact(F.array(F.lit(ALL), facet(F.col("categoria"))))
    return by.select(F.explode(labels).alias("nome"), "n").groupBy("nome").agg(F.sum("n").cast("long").alias("contagem"))


def in_facet(category: Column, label: str) -> Column:
    """Whether a row is shown under a label; unknown labels show all."""
    own = dict(FACETS).get(label)
    return F.lit(True) if own is None else category.isin(*own)


def has_text(columns: list[Column], term: str) -> Column:
    """Whether the term stands in the joined fields, without case; the empty term is in all."""
    term = term.strip().lower()
    if not term:
        return F.lit(True)
    return F.lower(F.concat_ws(" ", *[F.coalesce(c, F.lit("")) for c in columns])).contains(term)


def shown(index: DataFrame, label: str, term: str) -> DataFrame:
    """The rows that the screen shows under a label for a term, found in name, category, text and date joined."""
    cols = [F.col(c) for c in ("arquivo", "categoria", "texto", "data_documento")]
    return index.where(in_facet(F.col("categoria"), label) & has_text(cols, term))


def selected(rows: DataFrame, chosen: int | None) -> DataFrame:
    """``id``: the chosen row if it is shown, else the first of the rows, which come newest first."""
    one = rows.agg(F.max("id").alias("primeira"), F.bool_or(F.col("id") == F.lit(chosen).cast("long")).alias("ainda"))
    return one.select(F.when(F.col("ainda"), F.lit(chosen).cast("long")).otherwise(F.col("primeira")).alias("id"))


def details(rows: DataFrame, width: int = 160) -> DataFrame:
    """What the screen tells of each row: ``id``, ``arquivo``, ``tipo``, ``data`` (day first), ``destino``, ``chaves``, ``trecho``.

    ``chaves`` are the terms of the row's own category that its text holds, in the order of the rules; ``trecho`` is the
    beginning of the text in one line.
    """
    day = F.date_format(F.col("data_documento").try_cast("date"), "dd/MM/yyyy")
    line = F.trim(F.substring(F.regexp_replace(F.coalesce("texto", F.lit("")), r"[ \t\r\n]+", " "), 1, width))
    rows = rows.withColumn("_normal", normalized(F.coalesce("texto", F.lit(""))))
    return rows.select(
        "id", "arquivo", F.coalesce(facet(F.col("categoria")), F.col("categoria")).alias("tipo"), F.coalesce(day, F.lit("—")).alias("data"),
        F.col("caminho").alias("destino"), matched_terms(F.col("_normal"), F.col("categoria")).alias("chaves"), line.alias("trecho"),
    )


def screen(index: DataFrame, label: str, term: str, today: str, images: tuple[str, ...], limit: int = 50) -> DataFrame:
    """All that a screen needs for a label and a term, in long form: ``parte``, ``ordem``, ``nome``, ``valor``.

    ``linhas``: the newest ``limit`` of the shown rows by place, id and name; ``categorias``: each facet and its count;
    ``estatisticas``: each tile; ``todos``: how many rows are shown.  The page's rows alone are ordered.
    """
    visible = shown(index, label, term)
    page = limited(visible.select("id", "arquivo").orderBy(F.desc("id")), limit)
    lines = page.groupBy().agg(F.sort_array(F.collect_list(F.struct("id", "arquivo")), False).alias("l")).select(F.posexplode("l").alias("n", "x"))
    none = F.lit(0).alias("ordem")
    out = lines.select(F.lit("linhas").alias("parte"), (F.col("n") + 1).alias("ordem"), F.col("x.id").cast("string").alias("nome"), F.col("x.arquivo").alias("valor"))
    out = out.union(facet_counts(index).select(F.lit("categorias"), none, "nome", F.col("contagem").cast("string")))
    own = tiles(index, today, images)
    each = F.array(*[F.struct(F.lit(c).alias("nome"), F.col(c).cast("string").alias("valor")) for c in own.columns])
    out = out.union(own.select(F.explode(each).alias("x")).select(F.lit("estatisticas"), none, "x.nome", "x.valor"))
    return out.union(visible.agg(F.count("*").cast("string").alias("valor")).select(F.lit("todos"), none, F.lit("visiveis"), "valor"))


def tiles(index: DataFrame, today: str, images: tuple[str, ...]) -> DataFrame:
    """One row: archived documents, today's, those read from images, those to be reviewed."""
    image = F.lower(F.regexp_extract("arquivo", r"(?s)^.+(\.[^.]+)$", 1)).isin(*images)
    return index.agg(
        F.count("*").alias("arquivados"),
        F.count_if(F.date_format("processado_em", "yyyy-MM-dd") == today).alias("hoje"),
        F.count_if(image).alias("ocr"),
        F.count_if(F.col("categoria") == "outros").alias("revisar"),
    )


def printed(rows: DataFrame) -> DataFrame:
    """``id`` and the two lines that the console shows of each row."""
    date = F.coalesce(F.expr("nullif(data_documento, '')"), F.lit("sem data"))
    first = F.format_string("[%4d] %s  %-18s %s", F.col("id"), date, F.col("categoria"), F.col("arquivo"))
    return rows.select("id", F.concat(first, F.lit("\n       "), F.col("caminho")).alias("linhas"))
