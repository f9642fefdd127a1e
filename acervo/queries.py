"""The queries of the engine's own operators, and the SQL that states each of them."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable
from functools import lru_cache

from pyarrow.fs import FileSystem
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from acervo.functions import dates, scoring
from acervo.functions.text import human_size, normalized, stem, suffix
from acervo.operators import archive, index, ingest, search
from acervo.plans.rules import DEFAULT, IMAGE_EXTENSIONS, INDEXED, MONTHS, NOT_WATCHED, RULES, WATCHED
from acervo.plans.schemas import LISTED
from acervo.plans.tables import table
from acervo.plans.workspace import Workspace
from acervo.sources.config import Settings
from acervo.sources.inbox import listed
from acervo.streaming.watch import ingest_folder

Query = Callable[[SparkSession, str], DataFrame]
ROOT, BACKUP = "/dados/organizados", "/dados/copias"
ARRIVAL = ["lote", "entrada_id"]
TODAY = "2025-06-02"


def _docs(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documentos")


def _inbox(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "entrada")


def _normal(spark: SparkSession, d: str) -> DataFrame:
    return _docs(spark, d).where("texto IS NOT NULL").select("id", normalized(F.col("texto")).alias("normal"))


def _dates(make) -> Query:
    def run(spark: SparkSession, d: str) -> DataFrame:
        return _normal(spark, d).select("id", F.array_join(make(F.col("normal")), ",").alias("datas")).where("datas <> ''")

    return run


def _search(term: str, limit: int) -> Query:
    return lambda spark, d: search.search(_docs(spark, d), term, limit).drop("processado_em")


def score_board(spark: SparkSession, d: str) -> DataFrame:
    board = _normal(spark, d).select("id", F.explode(scoring.scores(F.col("normal"))).alias("s"))
    return board.select("id", "s.categoria", F.col("s.pontos").cast("long").alias("pontos"))


def classify(spark: SparkSession, d: str) -> DataFrame:
    return scoring.with_category(_normal(spark, d), "normal").select("id", "categoria")


def classify_documents(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "documents").where("text IS NOT NULL").select("doc_id", normalized(F.col("text")).alias("normal"))
    return scoring.with_category(rows, "normal").select("doc_id", "categoria")


def document_date(spark: SparkSession, d: str) -> DataFrame:
    text = normalized(F.coalesce("texto", F.lit("")))
    return _inbox(spark, d).select("entrada_id", dates.document_date(text, dates.modified_date(F.col("modificationtime"))).alias("data"))


def month_lookup(spark: SparkSession, d: str) -> DataFrame:
    hits = _normal(spark, d).select("id", F.explode(F.array_distinct(F.regexp_extract_all("normal", F.lit(dates.SPELLED), F.lit(2)))).alias("mes"))
    return hits.select("id", "mes", dates.month_number(F.col("mes")).cast("int").alias("numero"))


def path_parts(spark: SparkSession, d: str) -> DataFrame:
    name = F.col("arquivo")
    return _inbox(spark, d).select("entrada_id", stem(name).alias("raiz"), suffix(name).alias("sufixo"))


def archive_path(spark: SparkSession, d: str) -> DataFrame:
    rows = _docs(spark, d)
    return rows.select("id", archive.folder(ROOT, F.col("categoria"), F.col("data_documento")).alias("pasta"), archive.backup_folder(BACKUP, F.col("categoria")).alias("copia"))


def free_name(spark: SparkSession, d: str) -> DataFrame:
    """Names for all inbox files, were they all archived in one folder of each batch's year beside the index's files."""
    files = _inbox(spark, d).select("lote", "entrada_id", "arquivo", F.date_format("modificationtime", "yyyy").alias("pasta"))
    taken = _docs(spark, d).select(F.substring("data_documento", 1, 4).alias("pasta"), F.element_at(F.split("caminho", "/"), -1).alias("nome")).where("pasta IS NOT NULL")
    return archive.free_names(files, taken.distinct(), ARRIVAL, Workspace(spark, "names")).select("entrada_id", "nome")


def ingest_status(spark: SparkSession, d: str) -> DataFrame:
    return ingest.gated(_inbox(spark, d), _docs(spark, d), ARRIVAL).select("entrada_id", "ignorado")


def status_counts(spark: SparkSession, d: str) -> DataFrame:
    told = ingest.gated(_inbox(spark, d), _docs(spark, d), ARRIVAL)
    return told.groupBy("lote").agg(F.count_if(F.col("ignorado").isNull()).alias("sucessos"), F.count("*").alias("arquivos"))


def result_summary(spark: SparkSession, d: str) -> DataFrame:
    log = table(spark, d, "resultados")
    return log.groupBy("ignorado").agg(F.count("*").alias("n"), F.countDistinct("arquivo").alias("nomes"), F.max("data").alias("ultima"))


def orphan_results(spark: SparkSession, d: str) -> DataFrame:
    log = table(spark, d, "resultados").where("destino IS NOT NULL")
    return log.join(_docs(spark, d).select(F.col("caminho").alias("destino")), "destino", "left_anti").select("resultado_id", "destino")


def insert_ignore(spark: SparkSession, d: str) -> DataFrame:
    rows = _inbox(spark, d).where("erro IS NULL").select("lote", "entrada_id", "arquivo", F.col("path").alias("caminho"), F.lower("hash").alias("hash"))
    return index.insert_ignore(_docs(spark, d), rows, ARRIVAL, Workspace(spark, "insert")).select("id", "entrada_id")


def facet_rollup(spark: SparkSession, d: str) -> DataFrame:
    by = _docs(spark, d).rollup("categoria", archive.year(F.col("data_documento")).alias("ano"))
    return by.agg(F.count("*").alias("n"), F.grouping_id().cast("int").alias("nivel"))


def shown_of_total(spark: SparkSession, d: str) -> DataFrame:
    shown = search.in_facet(F.col("categoria"), "Contas") & search.has_text([F.col("arquivo"), F.col("categoria"), F.col("texto")], "água")
    return _docs(spark, d).agg(F.count_if(shown).alias("visiveis"), F.count("*").alias("total"))


def ui_search(spark: SparkSession, d: str) -> DataFrame:
    return search.shown(_docs(spark, d), "A revisar", " Prazo ").select("id")


def text_query(spark: SparkSession, d: str) -> DataFrame:
    """The text test alone, with a hit that spans two fields."""
    cols = [F.col(c) for c in ("arquivo", "categoria", "texto", "data_documento")]
    return _docs(spark, d).where(search.has_text(cols, "PDF boleto")).select("id")


def moved(spark: SparkSession, d: str) -> DataFrame:
    """A real inbox of text files taken in: files written, listed, read, hashed, gated, classified, archived, logged, moved."""
    work = Workspace(spark, "inbox")
    at = work.path
    rows = _inbox(spark, d).where("erro IS NULL AND texto IS NOT NULL")
    names = F.concat(F.format_string("%012d", "entrada_id"), F.when(F.col("entrada_id") % 7 == 0, F.lit(".exe")).otherwise(F.lit(".txt")))

    def write(part) -> None:
        store, to = FileSystem.from_uri(f"{at}/in")
        for r in part:
            with store.open_output_stream(f"{to}/{r.nome}") as f:
                f.write(r.texto.encode())

    settings = Settings(f"{at}/in", f"{at}/out", f"{at}/copy", f"{at}/index")
    settings.make_folders(spark)
    rows.select(names.alias("nome"), "texto").foreachPartition(write)
    told = ingest_folder(spark, settings)
    left = listed(spark, settings.inbox, content=False).select("path", F.lit(True).alias("ficou"))
    own = F.element_at(F.split("path", "/"), -1)
    return work.finish(told.join(left, "path", "left").select(own.substr(1, 12).cast("long").alias("entrada_id"), "categoria", "ignorado", F.coalesce("ficou", F.lit(False)).alias("ficou")))


def pipeline(spark: SparkSession, d: str) -> DataFrame:
    """All inbox files through gates, classification, dates and archive names, beside the whole index."""
    return ingest.results(_inbox(spark, d), _docs(spark, d), ROOT, ARRIVAL, Workspace(spark, "pipeline")).drop("lote")


def stream_ingest(spark: SparkSession, d: str) -> DataFrame:
    """The inbox table as a stream in micro-batches: hashes that the index lacks, first copies kept by an append-only sink."""
    work = Workspace(spark, "stream")
    known, schema = _docs(spark, d).select("hash").where("hash IS NOT NULL"), _inbox(spark, d).schema
    source = spark.readStream.schema(schema).option("maxFileAge", "36500d").option("pathGlobFilter", "entrada.parquet").parquet(d)
    source = source if not _is_folder(d) else spark.readStream.schema(schema).parquet(f"{d}/entrada.parquet")

    def sink(batch: DataFrame, n: int) -> None:
        fresh = batch.where("erro IS NULL AND hash IS NOT NULL").join(known, "hash", "left_anti")
        first = fresh.groupBy("hash").agg(F.min("entrada_id").alias("entrada_id"))
        first.write.mode("overwrite").parquet(f"{work.path}/seen/lote={n}")

    known.limit(0).select("hash", F.lit(0).cast("long").alias("entrada_id")).write.parquet(f"{work.path}/seen/lote=-1")
    query = source.writeStream.option("checkpointLocation", f"{work.path}/checkpoint").trigger(availableNow=True).foreachBatch(sink).start()
    query.awaitTermination()
    seen = spark.read.schema("hash string, entrada_id long").parquet(f"{work.path}/seen")
    return seen.groupBy("hash").agg(F.min("entrada_id").alias("entrada_id"))


def _is_folder(d: str) -> bool:
    import os

    return os.path.isdir(f"{d}/entrada.parquet")


def details(spark: SparkSession, d: str) -> DataFrame:
    return search.details(_docs(spark, d))


def screen(spark: SparkSession, d: str) -> DataFrame:
    return search.screen(_docs(spark, d), "Contas", "energia", TODAY, IMAGE_EXTENSIONS)


def selection(spark: SparkSession, d: str) -> DataFrame:
    """What stays chosen: a row that is not shown gives way to the first, one that is shown stays, and none is the first."""
    rows = search.shown(_docs(spark, d), "Contratos", "")
    cases = [search.selected(rows, n).select(F.lit(name).alias("caso"), "id") for name, n in (("some", -1), ("nada", None))]
    return cases[0].union(cases[1])


def news(spark: SparkSession, d: str) -> DataFrame:
    """The index as a stream of new rows, pushed to a table that each batch writes its own part of."""
    work = Workspace(spark, "news")
    source = spark.readStream.schema(_docs(spark, d).schema).option("maxFileAge", "36500d")
    source = source.parquet(f"{d}/documentos.parquet") if _is_folder(d) else source.option("pathGlobFilter", "documentos.parquet").parquet(d)
    query = source.select(*LISTED).writeStream.option("checkpointLocation", f"{work.path}/checkpoint").trigger(availableNow=True)
    query = query.foreachBatch(lambda rows, n: rows.drop("processado_em").write.mode("overwrite").parquet(f"{work.path}/rows/lote={n}")).start()
    query.awaitTermination()
    _docs(spark, d).limit(0).drop("processado_em").select(*[c for c in LISTED if c != "processado_em"]).write.mode("append").parquet(f"{work.path}/rows/lote=-1")
    return spark.read.parquet(f"{work.path}/rows").drop("lote")


def queries() -> dict[str, Query]:
    """Name to query."""
    return {
        "normalize_text": _normal,
        "content_hash": lambda s, d: table(s, d, "documents").where("text IS NOT NULL").select("doc_id", F.sha2("text", 256).alias("hash")),
        "dedup_first_wins": lambda s, d: index.first_copies(_inbox(s, d).where("erro IS NULL"), ARRIVAL).select("entrada_id", "hash"),
        "already_indexed_semi": lambda s, d: index.already_indexed(_inbox(s, d), _docs(s, d)).select("entrada_id"),
        "already_indexed_anti": lambda s, d: index.not_indexed(_inbox(s, d), _docs(s, d)).select("entrada_id"),
        "score_board": score_board,
        "score_theta_join": lambda s, d: scoring.score_rows(_normal(s, d), "id", "normal"),
        "classify": classify,
        "classify_documents": classify_documents,
        "dates_numeric": _dates(dates.numeric_dates),
        "dates_iso": _dates(dates.iso_dates),
        "dates_longform": _dates(dates.spelled_dates),
        "dates_all": _dates(dates.all_dates),
        "document_date": document_date,
        "month_lookup_join": month_lookup,
        "search_term": _search("Energia", 20),
        "search_date_prefix": _search("2024-03", -1),
        "search_wildcard": _search("conta%_2024", 50),
        "search_category": _search("NOTA_FISCAL", 20),
        "list_latest": lambda s, d: search.listing(_docs(s, d), 50).drop("processado_em"),
        "point_lookup": lambda s, d: _docs(s, d).where("id = 42").select("id", "arquivo", "categoria"),
        "extension_filter": lambda s, d: _inbox(s, d).where(F.lower(suffix(F.col("arquivo"))).isin(*WATCHED)).select("entrada_id"),
        "path_parts": path_parts,
        "archive_path": archive_path,
        "free_name": free_name,
        "ingest_status_audit": ingest_status,
        "success_count": status_counts,
        "result_summary": result_summary,
        "orphan_results": orphan_results,
        "upsert_ignore": insert_ignore,
        "facet_counts": lambda s, d: search.facet_counts(_docs(s, d)),
        "facet_rollup": facet_rollup,
        "stats_tiles": lambda s, d: search.tiles(_docs(s, d), TODAY, IMAGE_EXTENSIONS),
        "shown_of_total": shown_of_total,
        "ui_search_concat": ui_search,
        "ui_search_across_fields": text_query,
        "ui_screen": screen,
        "ui_details": details,
        "ui_selection": selection,
        "feed_of_new_rows": news,
        "human_size": lambda s, d: _inbox(s, d).select("entrada_id", human_size(F.col("length")).alias("tamanho")),
        "ingest_of_files": moved,
        "print_lines": lambda s, d: search.printed(_docs(s, d)),
        "pipeline_end_to_end": pipeline,
        "stream_ingest_available_now": stream_ingest,
    }


# --- the same in SQL ---------------------------------------------------------------------------------------------------


def _quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


@lru_cache(1)
def _folds() -> tuple[str, str, list[tuple[str, str]]]:
    """Compatibility forms of single characters after lower case: one to one as two strings, one to several as pairs."""
    one, to, many = [], [], []
    for code in [*range(0xA0, 0x2600), *range(0xFB00, 0xFB07), *range(0xFF01, 0xFFEF)]:
        c = chr(code)
        kind = unicodedata.decomposition(c)
        if not kind.startswith("<") or c.lower() != c:
            continue
        form = "".join(x for x in unicodedata.normalize("NFKD", c) if not unicodedata.combining(x))
        if len(form) == 1:
            one.append(c)
            to.append(form)
        elif code < 0x250 or 0x2000 <= code < 0x2200 or code >= 0xFB00:
            many.append((c, form))
    return "".join(one), "".join(to), many


def _sql_normal(column: str) -> str:
    one, to, many = _folds()
    out = f"lower({column})"
    for c, form in many:
        out = f"replace({out}, {_quoted(c)}, {_quoted(form)})"
    out = f"strip_accents(translate({out}, {_quoted(one)}, {_quoted(to)}))"
    out = f"regexp_replace({out}, '[\\x{{0300}}-\\x{{036f}}]', '', 'g')"
    return f"regexp_replace({out}, '[\\s\\x0b\\x1c-\\x1f\\x{{85}}\\p{{Z}}]+', ' ', 'g')"


def _sql_word(text: str, term: str) -> str:
    edge = "[^\\p{L}\\p{N}_]"
    return f"regexp_matches({text}, '(^|{edge}){term}($|{edge})')"


_NORMAL = f"normal AS MATERIALIZED (SELECT id, {_sql_normal('texto')} AS normal FROM documentos WHERE texto IS NOT NULL)"


def _sql_scores(source: str, key: str, text: str) -> str:
    rows = []
    for category, terms in RULES:
        points = " + ".join(f"CASE WHEN {_sql_word(text, t)} THEN {w} ELSE 0 END" for t, w in terms)
        rows.append(f"SELECT {key}, '{category}' AS categoria, CAST({points} AS BIGINT) AS pontos FROM {source}")
    return "SELECT * FROM (" + " UNION ALL ".join(rows) + ") WHERE pontos > 0"


def _sql_classes(source: str, key: str, text: str) -> str:
    """The winner of each row of ``source``."""
    return (
        f"SELECT s.{key}, CASE WHEN b.n = 1 THEN b.categoria ELSE '{DEFAULT}' END AS categoria FROM {source} s LEFT JOIN ("
        f"SELECT {key}, count(*) AS n, min(categoria) AS categoria FROM (SELECT *, max(pontos) OVER (PARTITION BY {key}) AS m FROM ({_sql_scores(source, key, text)})) "
        f"WHERE pontos = m GROUP BY {key}) b USING ({key})"
    )


def _sql_valid(day: str, month: str, year: str) -> str:
    y = f"CASE WHEN CAST({year} AS INT) < 100 THEN CAST({year} AS INT) + 2000 ELSE CAST({year} AS INT) END"
    iso = f"lpad(CAST({y} AS VARCHAR), 4, '0') || '-' || lpad({month}, 2, '0') || '-' || lpad({day}, 2, '0')"
    return f"CASE WHEN TRY_CAST({iso} AS DATE) IS NOT NULL THEN {iso} END"


def _sql_dates(text: str) -> tuple[str, str, str]:
    months = "|".join(MONTHS)
    number = "CASE split_part(h, ' de ', 2) " + " ".join(f"WHEN '{m}' THEN '{i + 1}'" for i, m in enumerate(MONTHS)) + " END"
    forms = (
        (r"\b\d{1,2}[/.-]\d{1,2}[/.-]\d{2,4}\b", _sql_valid("split_part(translate(h, './', '--'), '-', 1)", "split_part(translate(h, './', '--'), '-', 2)", "split_part(translate(h, './', '--'), '-', 3)")),
        (r"\b\d{4}-\d{2}-\d{2}\b", _sql_valid("split_part(h, '-', 3)", "split_part(h, '-', 2)", "split_part(h, '-', 1)")),
        (rf"\b\d{{1,2}} de (?:{months}) de \d{{4}}\b", _sql_valid("split_part(h, ' de ', 1)", number, "split_part(h, ' de ', 3)")),
    )
    return tuple(f"list_filter(list_transform(regexp_extract_all({text}, '{p}'), lambda h: {v}), lambda d: d IS NOT NULL)" for p, v in forms)


def _sql_date_rows(which: tuple[int, ...]) -> str:
    parts = _sql_dates("normal")
    both = " || ".join(parts[i] for i in which)
    return f"WITH {_NORMAL} SELECT * FROM (SELECT id, array_to_string({both}, ',') AS datas FROM normal) WHERE datas <> ''"


_STEM = "CASE WHEN regexp_matches({0}, '(?s)^.+\\.[^.]+$') THEN regexp_extract({0}, '(?s)^(.+)(\\.[^.]+)$', 1) ELSE {0} END"
_SUFFIX = "regexp_extract({0}, '(?s)^(.+)(\\.[^.]+)$', 2)"


def _sql_search(term: str, limit: int) -> str:
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    folded = _quoted(f"%{term}%".translate(str.maketrans(upper, lower)))
    hit = " OR ".join(f"translate({c}, '{upper}', '{lower}') LIKE {folded}" for c in ("arquivo", "categoria", "data_documento", "texto"))
    top = "" if limit < 0 else f" LIMIT {limit}"
    return f"SELECT id, arquivo, caminho, categoria, data_documento FROM documentos WHERE {hit} ORDER BY data_documento DESC NULLS LAST, id DESC{top}"


def _sql_gates() -> str:
    watched = ", ".join(_quoted(e) for e in WATCHED)
    return (
        f"portas AS (SELECT e.*, CASE WHEN lower({_SUFFIX.format('e.arquivo')}) NOT IN ({watched}) THEN '{NOT_WATCHED}' "
        f"WHEN e.hash IN (SELECT hash FROM documentos WHERE hash IS NOT NULL) THEN '{INDEXED}' WHEN e.erro IS NOT NULL THEN e.erro END AS porta FROM entrada e), "
        f"estados AS (SELECT *, CASE WHEN porta IS NOT NULL THEN porta WHEN hash IS NOT NULL AND row_number() OVER (PARTITION BY hash, porta IS NULL ORDER BY lote, entrada_id) > 1 THEN '{INDEXED}' END AS ignorado FROM portas)"
    )


def _sql_free_names(files: str, taken: str, key: str) -> str:
    """CTEs that end in ``nomes`` (key, pasta, nome) from CTEs of files (key, lote, entrada_id, pasta, arquivo) and names taken."""
    base = "CASE WHEN regexp_matches(nome, '(?s)^.* \\(\\d{1,9}\\)(\\.[^.]+)?$') THEN regexp_extract(nome, '(?s)^(.*) \\((\\d{1,9})\\)(\\.[^.]+)?$', 1) || regexp_extract(nome, '(?s)^(.*) \\((\\d{1,9})\\)(\\.[^.]+)?$', 3) END"
    number = "CAST(regexp_extract(nome, '(?s)^(.*) \\((\\d{1,9})\\)(\\.[^.]+)?$', 2) AS BIGINT)"
    name = f"CASE WHEN f.k + coalesce(o.c, 0) = 1 THEN f.arquivo ELSE {_STEM.format('f.arquivo')} || ' (' || CAST(f.k + coalesce(o.c, 0) AS VARCHAR) || ')' || {_SUFFIX.format('f.arquivo')} END"
    return (
        f"ordem AS (SELECT *, row_number() OVER (PARTITION BY pasta, arquivo ORDER BY lote, entrada_id) AS k FROM {files}), "
        f"usados AS (SELECT DISTINCT pasta, arquivo, e FROM (SELECT pasta, nome AS arquivo, 1 AS e FROM {taken} UNION ALL SELECT pasta, {base}, {number} FROM {taken} WHERE {base} IS NOT NULL AND {number} > 1)), "
        f"livres AS (SELECT pasta, arquivo, e - row_number() OVER (PARTITION BY pasta, arquivo ORDER BY e) AS livres FROM usados), "
        f"saltos AS (SELECT f.{key}, count(*) AS c FROM ordem f JOIN livres l ON f.pasta = l.pasta AND f.arquivo = l.arquivo AND l.livres < f.k GROUP BY f.{key}), "
        f"nomes AS (SELECT f.{key}, f.pasta, {name} AS nome FROM ordem f LEFT JOIN saltos o USING ({key}))"
    )


def oracle_sql() -> dict[str, str]:
    """Name to equivalent SQL."""
    labels = " UNION ALL ".join([f"SELECT '{search.ALL}' AS nome, id FROM documentos", *[f"SELECT '{label}', id FROM documentos WHERE categoria IN ({', '.join(map(_quoted, own))})" for label, own in search.FACETS]])
    images = ", ".join(map(_quoted, IMAGE_EXTENSIONS))
    date = " || ".join(_sql_dates("normal"))
    inbox = f"textos AS MATERIALIZED (SELECT entrada_id, {_sql_normal("coalesce(texto, '')")} AS normal FROM entrada)"
    year = "coalesce(split_part(data_documento, '-', 1), 'sem-data')"
    taken = "ocupados AS (SELECT DISTINCT substr(data_documento, 1, 4) AS pasta, regexp_extract(caminho, '[^/]*$') AS nome FROM documentos WHERE data_documento IS NOT NULL)"
    in_path = "ocupados AS (SELECT regexp_extract(caminho, '(?s)^(.*)/[^/]*$', 1) AS pasta, regexp_extract(caminho, '[^/]*$') AS nome FROM documentos)"
    months = ", ".join(f"('{m}', {i + 1})" for i, m in enumerate(MONTHS))
    joined = "lower(concat_ws(' ', coalesce(arquivo, ''), coalesce(categoria, ''), coalesce(texto, '')))"
    shown = "lower(concat_ws(' ', coalesce(arquivo, ''), coalesce(categoria, ''), coalesce(texto, ''), coalesce(data_documento, '')))"
    tiles = f"SELECT count(*) AS arquivados, count(*) FILTER (strftime(processado_em, '%Y-%m-%d') = '{TODAY}') AS hoje, count(*) FILTER (lower({_SUFFIX.format('arquivo')}) IN ({images})) AS ocr, count(*) FILTER (categoria = 'outros') AS revisar FROM documentos"
    kinds = " ".join(f"WHEN categoria IN ({', '.join(map(_quoted, own))}) THEN '{label}'" for label, own in search.FACETS)
    held = {c: "array_to_string(list_filter([" + ", ".join(f"CASE WHEN {_sql_word('normal', t)} THEN '{t}' END" for t, _ in own) + "], lambda t: t IS NOT NULL), ', ')" for c, own in RULES}
    terms = " ".join(f"WHEN categoria = '{c}' THEN coalesce({t}, '')" for c, t in held.items())
    return {
        "normalize_text": f"WITH {_NORMAL} SELECT * FROM normal",
        "content_hash": "SELECT doc_id, sha256(text) AS hash FROM documents WHERE text IS NOT NULL",
        "dedup_first_wins": "SELECT entrada_id, hash FROM (SELECT *, row_number() OVER (PARTITION BY hash ORDER BY lote, entrada_id) AS r FROM entrada WHERE erro IS NULL) WHERE r = 1 OR hash IS NULL",
        "already_indexed_semi": "SELECT entrada_id FROM entrada e WHERE EXISTS (SELECT 1 FROM documentos d WHERE d.hash = e.hash)",
        "already_indexed_anti": "SELECT entrada_id FROM entrada e WHERE NOT EXISTS (SELECT 1 FROM documentos d WHERE d.hash = e.hash)",
        "score_board": f"WITH {_NORMAL} {_sql_scores('normal', 'id', 'normal')}",
        "score_theta_join": f"WITH {_NORMAL} {_sql_scores('normal', 'id', 'normal')}",
        "classify": f"WITH {_NORMAL} {_sql_classes('normal', 'id', 'normal')}",
        "classify_documents": f"WITH t AS MATERIALIZED (SELECT doc_id, {_sql_normal('text')} AS normal FROM documents WHERE text IS NOT NULL) {_sql_classes('t', 'doc_id', 'normal')}",
        "dates_numeric": _sql_date_rows((0,)),
        "dates_iso": _sql_date_rows((1,)),
        "dates_longform": _sql_date_rows((2,)),
        "dates_all": _sql_date_rows((0, 1, 2)),
        "document_date": f"WITH {inbox} SELECT t.entrada_id, coalesce(({date})[1], strftime(e.modificationtime, '%Y-%m-%d')) AS data FROM textos t JOIN entrada e USING (entrada_id)",
        "month_lookup_join": f"WITH {_NORMAL} SELECT DISTINCT id, mes, CAST(numero AS INT) AS numero FROM (SELECT id, unnest(regexp_extract_all(normal, '\\b\\d{{1,2}} de ({'|'.join(MONTHS)}) de \\d{{4}}\\b', 1)) AS mes FROM normal) JOIN (VALUES {months}) m(mes, numero) USING (mes)",
        "search_term": _sql_search("Energia", 20),
        "search_date_prefix": _sql_search("2024-03", -1),
        "search_wildcard": _sql_search("conta%_2024", 50),
        "search_category": _sql_search("NOTA_FISCAL", 20),
        "list_latest": "SELECT id, arquivo, caminho, categoria, data_documento FROM documentos ORDER BY id DESC LIMIT 50",
        "point_lookup": "SELECT id, arquivo, categoria FROM documentos WHERE id = 42",
        "extension_filter": f"SELECT entrada_id FROM entrada WHERE lower({_SUFFIX.format('arquivo')}) IN ({', '.join(map(_quoted, WATCHED))})",
        "path_parts": f"SELECT entrada_id, {_STEM.format('arquivo')} AS raiz, {_SUFFIX.format('arquivo')} AS sufixo FROM entrada",
        "archive_path": f"SELECT id, '{ROOT}/' || categoria || '/' || {year} AS pasta, '{BACKUP}/' || categoria AS copia FROM documentos",
        "free_name": f"WITH arquivos AS (SELECT lote, entrada_id, arquivo, strftime(modificationtime, '%Y') AS pasta FROM entrada), {taken}, {_sql_free_names('arquivos', 'ocupados', 'entrada_id')} SELECT entrada_id, nome FROM nomes",
        "ingest_status_audit": f"WITH {_sql_gates()} SELECT entrada_id, ignorado FROM estados",
        "success_count": f"WITH {_sql_gates()} SELECT lote, count(*) FILTER (ignorado IS NULL) AS sucessos, count(*) AS arquivos FROM estados GROUP BY lote",
        "result_summary": "SELECT ignorado, count(*) AS n, count(DISTINCT arquivo) AS nomes, max(data) AS ultima FROM resultados GROUP BY ignorado",
        "orphan_results": "SELECT resultado_id, destino FROM resultados r WHERE destino IS NOT NULL AND NOT EXISTS (SELECT 1 FROM documentos d WHERE d.caminho = r.destino)",
        "upsert_ignore": (
            "WITH novos AS (SELECT lote, entrada_id, path, lower(hash) AS hash FROM entrada e WHERE erro IS NULL AND NOT EXISTS (SELECT 1 FROM documentos d WHERE d.hash = lower(e.hash)) AND NOT EXISTS (SELECT 1 FROM documentos d WHERE d.caminho = e.path)), "
            "a AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY hash ORDER BY lote, entrada_id) AS r FROM novos) WHERE r = 1 OR hash IS NULL), "
            "b AS (SELECT * FROM (SELECT * EXCLUDE (r), row_number() OVER (PARTITION BY path ORDER BY lote, entrada_id) AS s FROM a) WHERE s = 1) "
            "SELECT (SELECT max(id) FROM documentos) + row_number() OVER (ORDER BY lote, entrada_id) AS id, entrada_id FROM b"
        ),
        "facet_counts": f"SELECT nome, count(*) AS contagem FROM ({labels}) GROUP BY nome",
        "facet_rollup": f"SELECT categoria, ano, count(*) AS n, CAST(grouping(categoria, ano) AS INT) AS nivel FROM (SELECT categoria, {year} AS ano FROM documentos) GROUP BY ROLLUP (categoria, ano)",
        "stats_tiles": tiles,
        "shown_of_total": f"SELECT count(*) FILTER (categoria IN ('conta_luz', 'conta_agua') AND contains({joined}, 'água')) AS visiveis, count(*) AS total FROM documentos",
        "ui_search_concat": f"SELECT id FROM documentos WHERE categoria = 'outros' AND contains({shown}, 'prazo')",
        "ui_search_across_fields": f"SELECT id FROM documentos WHERE contains({shown}, 'pdf boleto')",
        "ui_screen": (
            f"WITH visiveis AS (SELECT * FROM documentos WHERE categoria IN ('conta_luz', 'conta_agua') AND contains({shown}, 'energia')), blocos AS ({tiles}) "
            "SELECT 'linhas' AS parte, CAST(row_number() OVER (ORDER BY id DESC) AS INT) AS ordem, CAST(id AS VARCHAR) AS nome, arquivo AS valor FROM (SELECT * FROM visiveis ORDER BY id DESC LIMIT 50) "
            f"UNION ALL SELECT 'categorias', 0, nome, CAST(count(*) AS VARCHAR) FROM ({labels}) GROUP BY nome "
            "UNION ALL SELECT 'estatisticas', 0, nome, CAST(n AS VARCHAR) FROM (UNPIVOT blocos ON arquivados, hoje, ocr, revisar INTO NAME nome VALUE n) "
            "UNION ALL SELECT 'todos', 0, 'visiveis', CAST(count(*) AS VARCHAR) FROM visiveis"
        ),
        "ui_details": (
            f"WITH {_NORMAL} SELECT d.id, arquivo, CASE {kinds} ELSE categoria END AS tipo, coalesce(strftime(TRY_CAST(data_documento AS DATE), '%d/%m/%Y'), '—') AS data, caminho AS destino, "
            f"CASE {terms} ELSE '' END AS chaves, trim(substring(regexp_replace(coalesce(texto, ''), '[ \t\r\n]+', ' ', 'g'), 1, 160), ' ') AS trecho FROM documentos d LEFT JOIN normal n USING (id)"
        ),
        "ui_selection": "SELECT unnest(['some', 'nada']) AS caso, max(id) AS id FROM documentos WHERE categoria = 'contrato'",
        "feed_of_new_rows": "SELECT id, arquivo, caminho, categoria, data_documento FROM documentos",
        "human_size": "SELECT entrada_id, CASE WHEN length < 1024 THEN length || ' B' WHEN length < 1048576 THEN CAST(floor(length / 1024.0 + 0.5) AS BIGINT) || ' KB' ELSE replace(printf('%.1f', round(length / 1048576.0, 1)), '.', ',') || ' MB' END AS tamanho FROM entrada",
        "ingest_of_files": (
            f"WITH arquivos AS (SELECT entrada_id, texto, entrada_id % 7 = 0 AS exe, row_number() OVER (PARTITION BY entrada_id % 7 = 0, sha256(texto) ORDER BY entrada_id) AS r FROM entrada WHERE erro IS NULL AND texto IS NOT NULL), "
            f"textos AS MATERIALIZED (SELECT entrada_id, {_sql_normal('texto')} AS normal FROM arquivos WHERE NOT exe AND r = 1), classes AS ({_sql_classes('textos', 'entrada_id', 'normal')}) "
            f"SELECT entrada_id, categoria, CASE WHEN exe THEN '{NOT_WATCHED}' WHEN r > 1 THEN '{INDEXED}' END AS ignorado, exe OR r > 1 AS ficou FROM arquivos LEFT JOIN classes USING (entrada_id)"
        ),
        "print_lines": "SELECT id, '[' || CASE WHEN length(CAST(id AS VARCHAR)) < 4 THEN lpad(CAST(id AS VARCHAR), 4, ' ') ELSE CAST(id AS VARCHAR) END || '] ' || coalesce(nullif(data_documento, ''), 'sem data') || '  ' || CASE WHEN length(categoria) < 18 THEN rpad(categoria, 18, ' ') ELSE categoria END || ' ' || arquivo || chr(10) || '       ' || caminho AS linhas FROM documentos",
        "pipeline_end_to_end": (
            f"WITH {_sql_gates()}, textos AS MATERIALIZED (SELECT entrada_id, {_sql_normal("coalesce(texto, '')")} AS normal FROM estados WHERE ignorado IS NULL), "
            f"classes AS ({_sql_classes('textos', 'entrada_id', 'normal')}), "
            f"datados AS (SELECT e.lote, e.entrada_id, e.arquivo, c.categoria, coalesce(({date})[1], strftime(e.modificationtime, '%Y-%m-%d')) AS data FROM estados e JOIN textos t USING (entrada_id) JOIN classes c USING (entrada_id)), "
            f"arquivos AS (SELECT *, '{ROOT}/' || categoria || '/' || split_part(data, '-', 1) AS pasta FROM datados), {in_path}, {_sql_free_names('arquivos', 'ocupados', 'entrada_id')} "
            "SELECT e.entrada_id, e.arquivo, a.categoria, a.data, n.pasta || '/' || n.nome AS destino, e.ignorado FROM estados e LEFT JOIN arquivos a USING (entrada_id) LEFT JOIN nomes n USING (entrada_id)"
        ),
        "stream_ingest_available_now": "SELECT hash, min(entrada_id) AS entrada_id FROM entrada e WHERE erro IS NULL AND hash IS NOT NULL AND NOT EXISTS (SELECT 1 FROM documentos d WHERE d.hash = e.hash) GROUP BY hash",
    }
