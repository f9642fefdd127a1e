import json
import os
import threading
import time

import pytest

from acervo.cli import main
from acervo.plans.workspace import Workspace, shared_dir
from acervo.sources.config import Settings, read_settings
from acervo.sources.inbox import extract, listed, settled
from acervo.streaming.watch import backlog, feed, ingest_folder, open_index, open_log, successes, watch


def _settings(spark, tmp_path, **more) -> Settings:
    settings = Settings(*(str(tmp_path / x) for x in ("in", "out", "copy", "index")), **more)
    settings.make_folders(spark)
    return settings


def _put(settings, name, text, age=0.0):
    p = os.path.join(settings.inbox, name)
    with open(p, "wb") as f:
        f.write(text if isinstance(text, bytes) else text.encode())
    os.utime(p, (time.time() - age, time.time() - age))


def test_folder_twice(spark, tmp_path, capsys):
    config = _settings(spark, tmp_path)
    _put(config, "a b.TXT", "Boleto vencimento 05/04/2026, cedente")
    _put(config, "b.txt", "Boleto vencimento 05/04/2026, cedente")
    _put(config, "_c.txt", "Contrato das partes")
    _put(config, ".oculto.txt", "Contrato")
    _put(config, "vazio.txt", "")
    _put(config, "d.exe", "x")
    _put(config, "e.pdf", b"%PDF-1.4 quebrado")
    told = {r.arquivo: r for r in ingest_folder(spark, config).collect()}
    assert set(told) == {"a b.TXT", "b.txt", "_c.txt", "vazio.txt", "d.exe", "e.pdf"}
    assert told["a b.TXT"].categoria == "boleto" and told["a b.TXT"].data == "2026-04-05" and told["b.txt"].ignorado == "ja indexado"
    assert told["d.exe"].ignorado == "extensao nao monitorada" and told["e.pdf"].ignorado is not None
    assert (tmp_path / "out" / "boleto" / "2026" / "a b.TXT").exists() and (tmp_path / "copy" / "boleto" / "a b.TXT").exists()
    assert not (tmp_path / "in" / "a b.TXT").exists() and (tmp_path / "in" / "d.exe").exists() and told["a b.TXT"].copia.endswith("/copy/boleto/a b.TXT")
    rows = open_index(spark, config.index).collect()
    assert sorted(r.arquivo for r in rows) == ["_c.txt", "a b.TXT", "vazio.txt"] and sorted(r.id for r in rows) == [1, 2, 3]
    again = ingest_folder(spark, config).collect()
    assert all(r.ignorado for r in again)
    _put(config, "a b.TXT", "Outro boleto de 06/04/2026, cedente")
    more = ingest_folder(spark, config)
    assert [r.destino for r in more.collect() if not r.ignorado][0].endswith("/boleto/2026/a b (2).TXT") and successes(more) == 1
    assert (tmp_path / "copy" / "boleto" / "a b (2).TXT").exists()
    log = open_log(spark, config.log)
    assert log.count() == 6 + 3 + 4 and log.select("lote").distinct().count() == 3
    path = tmp_path / "c.json"
    path.write_text(f'{{"banco": "{config.index}", "pasta_entrada": "{config.inbox}", "pasta_saida": "{config.archive}"}}')
    assert main(["--config", str(path), "buscar", "BOLETO", "--limite", "1"], spark) == 0
    assert "boleto" in capsys.readouterr().out
    assert main(["--config", str(path), "buscar", "nada disso"], spark) == 0
    assert capsys.readouterr().out == "nenhum documento encontrado\n"


def test_stream_takes_old_files_in_batches(spark, tmp_path):
    config = _settings(spark, tmp_path)
    for i in range(5):
        _put(config, f"f{i}.txt", f"Recibo pix {i % 4}", age=86400 * 400 * (i % 2))
    query = backlog(spark, config, str(tmp_path / "checkpoint"), per_batch=2)
    query.awaitTermination()
    rows = open_index(spark, config.index).collect()
    assert len(rows) == 4 and {r.categoria for r in rows} == {"comprovante"} and sorted(r.id for r in rows) == [1, 2, 3, 4]


def test_readers():
    assert extract(b"a\r\nb\xff\rc", ".md") == ("a\nb\nc", None)
    assert extract(b"x", ".docx") == (None, "formato nao suportado: .docx")
    assert extract(b"x", ".png")[0] is None


def test_listing_skips_folders_and_dots(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / ".x").write_text("a")
    (tmp_path / "y").write_text("")
    assert [os.path.basename(r.path) for r in listed(spark, str(tmp_path)).collect()] == ["y"]


def test_settings(tmp_path):
    p = tmp_path / "c.json"
    p.write_text('{"extensoes": [".PDF"], "pasta_backup": "", "outra": 1, "banco": "~/b"}')
    c = read_settings(str(p))
    assert c.extensions == (".pdf",) and c.backup is None and "~" not in c.index and c.log == f"{c.index}-resultados"
    assert read_settings(str(tmp_path / "nada.json")) == Settings()
    for wrong in ({"banco": 3}, {"extensoes": ".pdf"}, [1]):
        p.write_text(json.dumps(wrong))
        with pytest.raises(ValueError):
            read_settings(str(p))


def test_extensions_are_those_of_the_settings(spark, tmp_path):
    settings = _settings(spark, tmp_path, extensions=(".md",))
    _put(settings, "a.md", "Contrato")
    _put(settings, "b.txt", "Contrato")
    assert {r.arquivo: r.ignorado for r in ingest_folder(spark, settings).collect()} == {"a.md": None, "b.txt": "extensao nao monitorada"}


def test_a_batch_that_is_run_again_adds_nothing(spark, tmp_path):
    from acervo.streaming.watch import ingest

    settings = _settings(spark, tmp_path)
    _put(settings, "a.txt", "Boleto cedente")
    raw = listed(spark, settings.inbox)
    for _ in range(2):  # the first run ends before its files are moved
        ingest(raw, settings, "7", move=False)
    assert open_index(spark, settings.index).count() == 1 and open_log(spark, settings.log).count() == 1


def test_watch_finds_what_the_file_source_hides(spark, tmp_path):
    settings = _settings(spark, tmp_path)
    query = watch(spark, settings, str(tmp_path / "checkpoint"), every=0.5, gate=lambda p: settled(p, 3, 0.1))
    try:
        _put(settings, "_a.txt", "Contrato das partes")
        _put(settings, "vazio.txt", "")
        _put(settings, ".b.txt", "x")
        _put(settings, "velho.txt", "Boleto cedente", age=86400 * 400)
        end = time.time() + 60
        while time.time() < end and set(os.listdir(settings.inbox)) != {".b.txt"}:
            time.sleep(0.3)
    finally:
        query.stop()
    assert sorted(r.arquivo for r in open_index(spark, settings.index).collect()) == ["_a.txt", "vazio.txt", "velho.txt"]


def test_the_gate_waits_for_a_copy_to_end(spark, tmp_path):
    growing, gone = tmp_path / "cresce.txt", tmp_path / "some.txt"
    growing.write_text("")
    gone.write_text("x")

    def copy():
        for _ in range(6):
            with growing.open("a") as f:
                f.write("parte ")
            time.sleep(0.15)

    paths = listed(spark, str(tmp_path), content=False)
    assert settled(paths.where("false")) is None
    gone.unlink()
    writer = threading.Thread(target=copy)
    writer.start()
    got = {os.path.basename(r.path): bytes(r.content) for r in settled(paths, 20, 0.4).collect()}
    writer.join()
    assert got == {"cresce.txt": b"parte " * 6}


def test_feed_of_new_rows(spark, tmp_path):
    settings = _settings(spark, tmp_path)
    news = feed(spark, settings.index).writeStream.format("memory").queryName("novidades").option("checkpointLocation", str(tmp_path / "feed")).start()
    try:
        _put(settings, "a.txt", "Boleto cedente")
        ingest_folder(spark, settings)
        news.processAllAvailable()
        _put(settings, "b.txt", "Contrato")
        ingest_folder(spark, settings)
        news.processAllAvailable()
        assert [r.arquivo for r in spark.table("novidades").orderBy("id").collect()] == ["a.txt", "b.txt"]
    finally:
        news.stop()


def test_workspace_keeps_the_result_only(spark):
    work = Workspace(spark, "test")
    part = work.save(spark.range(5), "part")
    out = work.finish(part.where("id > 1"))
    assert out.count() == 3 and os.listdir(work.path.removeprefix("file://")) == ["result"]
    work.drop()
    assert not os.path.exists(work.path.removeprefix("file://"))


def test_a_cluster_has_to_name_its_shared_folder():
    class Conf(dict):
        set = dict.__setitem__

    class Session:
        conf = Conf({"spark.master": "spark://a:7077"})

    with pytest.raises(ValueError):
        shared_dir(Session())
    Session.conf = Conf({"spark.master": "local[4]"})
    assert shared_dir(Session()) == Session.conf["spark.checkpoint.dir"]
