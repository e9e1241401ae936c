"""Pages of a service as a stream: a server that fails, a run that is cut, a list that grows."""

import threading
import urllib.parse
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

import pytest

from folioforge.operators.buckets import Buckets
from folioforge.sources import paging
from folioforge.sources.paging import OaiPages, PageReader
from folioforge.streaming import jobs


class Service:
    """Records (identifier, date) in pages of three; ``wrong`` says how many more times a page answers with an error."""

    def __init__(self):
        self.records = [(f"2301.{i:05d}", f"2024-01-{1 + i // 4:02d}") for i in range(20)]
        self.wrong, self.asked, service = {}, [], self

        class Handler(BaseHTTPRequestHandler):
            def do_GET(self):  # noqa: N802
                ask = dict(urllib.parse.parse_qsl(urllib.parse.urlparse(self.path).query))
                since, at = (ask["resumptionToken"].split("/") if "resumptionToken" in ask else (ask.get("from", ""), "0"))
                service.asked.append((since, int(at)))
                if service.wrong.get(int(at), 0):
                    service.wrong[int(at)] -= 1
                    self.send_response(503)
                    self.end_headers()
                    return
                own = [r for r in service.records if r[1] >= since]
                some = own[int(at) : int(at) + 3]
                made = "".join(f"<record><header><datestamp>{d}</datestamp></header><metadata><arXiv><id>{i}</id><title>T {i} &amp; more</title></arXiv></metadata></record>" for i, d in some)
                more = f'<resumptionToken cursor="{at}">{since}/{int(at) + 3}</resumptionToken>' if int(at) + 3 < len(own) else "<resumptionToken/>"
                body = f'<OAI-PMH xmlns="http://www.openarchives.org/OAI/2.0/"><ListRecords>{made}{more}</ListRecords></OAI-PMH>' if some else "<OAI-PMH><error code='noRecordsMatch'/></OAI-PMH>"
                self.send_response(200)
                self.end_headers()
                self.wfile.write(body.encode())

            def log_message(self, *a):
                pass

        self.server = ThreadingHTTPServer(("127.0.0.1", 0), Handler)
        threading.Thread(target=self.server.serve_forever, daemon=True).start()
        self.pages = OaiPages(f"http://127.0.0.1:{self.server.server_port}/oai", attempts=2, pause=0.01)


@pytest.fixture
def service():
    s = Service()
    yield s
    s.server.shutdown()


def collected(spark, service, checkpoint, most=2, every="0 seconds"):
    """Starts a query that keeps what each batch brought."""
    seen = []
    rows = paging.oai_records(paging.stream(spark, service.pages, most=most)).select("arxiv_id")
    q = rows.writeStream.foreachBatch(lambda b, i: seen.append((i, sorted(r.arxiv_id for r in b.collect())))).option("checkpointLocation", checkpoint).trigger(processingTime=every).start()
    return q, seen


def test_a_cut_run_resumes_without_loss_or_repeats(spark, service, tmp_path):
    service.wrong = {9: 10**6}  # the fourth page fails for good
    q, first = collected(spark, service, str(tmp_path / "c"))
    with pytest.raises(Exception, match="503"):
        q.processAllAvailable()
    q.stop()
    assert [i for i, _ in first] == [0] and len(first[0][1]) == 6
    service.wrong, service.asked = {12: 1}, []  # mended; another page fails once
    q, rest = collected(spark, service, str(tmp_path / "c"))
    q.processAllAvailable()
    q.stop()
    got = [x for _, ids in first + rest for x in ids]
    assert sorted(got) == [i for i, _ in service.records] and len(got) == 20
    assert [i for i, _ in rest] == [1, 2, 3] and ("", 0) not in service.asked  # never from the first page again


def test_polling_takes_what_is_new(spark, service, tmp_path):
    store = Buckets(spark, str(tmp_path / "t"), "arxiv_id string, title string", ["arxiv_id"], 4)
    told = []
    rows = paging.oai_records(paging.stream(spark, service.pages, most=3)).select("arxiv_id", "title")
    q = jobs.into_buckets(rows, store, str(tmp_path / "c"), every="1 second", report=lambda i, t: told.append(i))
    q.processAllAvailable()
    assert store.read().count() == 20
    service.records.append(("2302.00001", "2024-01-05"))  # of the latest day, which is listed again
    q.processAllAvailable()
    assert store.read().count() == 21
    batches = len(told)
    q.processAllAvailable()
    q.stop()
    assert len(told) == batches and store.read().filter("title = 'T 2302.00001 & more'").count() == 1


def test_tokens_are_followed_again_after_a_restart(service):
    reader = PageReader(service.pages, "2024-01-02", 100)
    start, end = reader.initialOffset(), reader.latestOffset()
    assert end["page"] == 6 and end["token"] == "" and end["since"] == "2024-01-05" and reader.latestOffset() == end
    other = PageReader(service.pages, "2024-01-02", 100)
    assert [p.token for p in other.partitions(start, end)] == [p.token for p in reader.partitions(start, end)] == ["", *(f"2024-01-02/{3 * i}" for i in range(1, 6))]
    assert other.partitions(end, end) == [] and other.latestOffset() == end
    reader.commit(end)
    assert reader.chain == {}


def test_expired_tokens_and_empty_lists(spark):
    class Pages:
        def fetch(self, token, since):
            return "<error code='badResumptionToken'/>" if token else "<record><datestamp>2024-02-02</datestamp></record>"

    reader = PageReader(Pages(), "", 5)
    after = reader._after({"page": 7, "token": "old", "since": "2024-01-01", "latest": "2024-01-01", "sum": "5"})
    assert after["page"] == 8 and after["since"] == "2024-02-02" and reader.chain[7][:2] == ("", "2024-01-01")

    class Empty:
        def fetch(self, token, since):
            return ""

    reader = PageReader(Empty(), "", 5)
    assert reader.latestOffset() == reader.initialOffset()
    assert paging.oai_records(spark.createDataFrame([("",), (None,), ("<record>",)], "payload string")).collect() == []


def test_micro_batches_grow_with_the_list(monkeypatch):
    """The store is looked up once a micro-batch: 160 times for 5,000 pages in batches of 32, where it is now eight."""

    class Pages:
        def fetch(self, token, since):
            n = int(token or 0)
            return "" if since and not token else f"<record><datestamp>2024-01-01</datestamp>{n}</record>" + (f"<resumptionToken>{n + 1}</resumptionToken>" if n < 4999 else "")

    reader = PageReader(Pages(), "", 32, growing=True)
    at, batches, seen = reader.initialOffset(), 0, []
    while (after := reader.latestOffset())["page"] > at["page"]:
        parts = reader.partitions(at, after)
        assert len(parts) <= paging.MOST_TASKS
        seen += [row[:2] for p in parts for row in reader.read(p)]
        reader.commit(after)
        at, batches = after, batches + 1
    assert seen == [(i, str(i) if i else "") for i in range(5000)] and batches < 10
