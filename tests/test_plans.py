"""Sources, services, requests, validation, responses, streams."""

import json
import threading
import time
from http.server import BaseHTTPRequestHandler, HTTPServer

import pytest
from pyspark.sql import functions as F

from shapeloom import functions as J
from shapeloom.operators import order_by, project, where_numbers
from shapeloom.plans import requests as R
from shapeloom.plans import responses, validation
from shapeloom.plans.services import Context, ServiceError, Services
from shapeloom.sources import Catalog, ConfigError, Provider, elements, parse_documents
from shapeloom.streaming import open_stream, run_to_end, stateless

GOOD = {"base_url": "http://h", "endpoints": {"a": "/a/{id}", "b": {"path": "b", "timeout": 5}}}


@pytest.mark.parametrize("change", [{"base_url": ""}, {"base_url": "nohost"}, {"timeout": 400_000}, {"timeout": 0}, {"connection_timeout": -1}, {"endpoints": {}}, {"endpoints": {"a": " "}}, {"endpoints": {"a": {"path": "a", "timeout": 300_001}}}, {"redirections_max": -1}])
def test_bad_providers(change):
    with pytest.raises(ConfigError):
        Provider.of(GOOD | change)


def test_urls_and_timeouts():
    p = Provider.of(GOOD | {"query": {"k": "v"}})
    assert p.url("a", {"id": 42}) == "http://h/a/42?k=v" and p.url("b") == "http://h/b?k=v"
    assert (p.timeout("a"), p.timeout("b")) == (10_000, 5)
    assert Provider.of({"host": "http://h/", "path": "/v1", "endpoints": {"a": "/a"}}).url("a") == "http://h/v1/a"
    with pytest.raises(KeyError):
        p.url("a")


CALLS = []


class Handler(BaseHTTPRequestHandler):
    def do_GET(self):
        CALLS.append(self.path)
        if self.path.startswith("/bad"):
            self.send_error(500)
            return
        self.send_response(200)
        self.end_headers()
        self.wfile.write(json.dumps({"path": self.path, "token": self.headers.get("X-Token")}).encode() if self.path != "/big" else b"x" * 100)

    def do_POST(self):
        self.send_response(200)
        self.end_headers()
        self.wfile.write(self.rfile.read(int(self.headers["Content-Length"])))

    def log_message(self, *_):
        pass


@pytest.fixture(scope="module")
def server():
    s = HTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=s.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{s.server_port}"
    s.shutdown()


def test_http(spark, server):
    config = {"base_url": server, "headers": {"X-Token": "t"}, "endpoints": {"one": "/x/{id}", "bad": "/bad", "post": "/p"}}
    c = Catalog(spark, {"p": Provider.of(config), "o": Provider.of(config | {"optional": True})})
    document = parse_documents(c.fetch("p", "one", {"id": 7})).select(J.lookup("document", "path"), J.lookup("document", "token")).first()
    assert tuple(document) == ("/x/7", "t")
    assert c.fetch("p", "post", method="post", body={"a": 1}).first().body == '{"a": 1}'
    assert c.fetch("o", "bad").first().body is None
    with pytest.raises(Exception, match="500"):
        c.fetch("p", "bad").collect()
    assert c.fetch("p", "one", {"id": 7}) is c.fetch("p", "one", {"id": 7}) and c.fetch("p", "one", {"id": 7}) is not c.fetch("p", "one", {"id": 8})
    with pytest.raises(KeyError):
        c.fetch("p", "none")
    assert list(c.check()) == ["p.one", "p.bad", "o.one"] or "p.bad" in c.check()


def test_http_for_each_request(spark, server):
    """Requests drive the calls: path, headers and body from their columns."""
    config = {"base_url": server, "query": {"k": "v"}, "headers": {"X-Token": "t"}, "endpoints": {"one": "/x/{id}/y", "cached": {"path": "/c/{id}", "use_cache": True}, "bad": "/bad", "post": "/p"}}
    c = Catalog(spark, {"p": Provider.of(config), "o": Provider.of(config | {"optional": True})})
    requests = spark.createDataFrame([(1, "a b", "u"), (2, "é/", None), (3, "a b", "w"), (4, None, "w")], "request_id long, id string, token string")
    got = c.fetch_each(requests, "o", "one", {"id": F.col("id")}, headers={"X-Token": F.col("token")}).collect()
    body = {r.request_id: r.answer.body and json.loads(r.answer.body) for r in got}
    assert body == {1: {"path": "/x/a%20b/y?k=v", "token": "u"}, 2: {"path": "/x/%C3%A9%2F/y?k=v", "token": None}, 3: {"path": "/x/a%20b/y?k=v", "token": "w"}, 4: None}
    assert {r.request_id: r.answer.status for r in got} == {1: 200, 2: 200, 3: 200, 4: None}
    with pytest.raises(Exception, match="parameter for one is missing"):
        c.fetch_each(requests, "p", "one", {"id": F.col("id")}).collect()
    posted = c.fetch_each(requests, "p", "post", method="POST", body=F.to_json(F.struct("id"))).collect()
    assert {r.request_id: r.answer.body for r in posted} == {1: '{"id":"a b"}', 2: '{"id":"é/"}', 3: '{"id":"a b"}', 4: "{}"}
    assert {r.answer.body for r in c.fetch_each(requests, "o", "bad").collect()} == {None}
    CALLS.clear()
    cached = c.fetch_each(requests.where("id is not null"), "p", "cached", {"id": F.col("id")})
    assert cached.count() == 3 and len({r.answer.body for r in cached.collect()}) == 2 and sorted(CALLS) == ["/c/%C3%A9%2F?k=v", "/c/a%20b?k=v"]
    c.close()
    assert c.fetch_each(requests.where("false"), "p", "one", {"id": F.col("id")}).count() == 0


def test_answers_are_kept(spark, server):
    config = {"base_url": server, "endpoints": {"kept": {"path": "/k", "use_cache": True}, "not": "/n"}}
    c = Catalog(spark, {"p": Provider.of(config)})
    CALLS.clear()
    for _ in range(2):
        assert c.fetch("p", "kept").first().status == c.fetch("p", "not").first().status == 200
    assert sorted(CALLS) == ["/k", "/n", "/n"]
    c.close()
    c.fetch("p", "kept").collect()
    assert len(CALLS) == 4


def test_url_of_an_optional_provider(spark):
    config = {"base_url": "http://127.0.0.1:9", "endpoints": {"one": "/x/{id}"}}
    c = Catalog(spark, {"p": Provider.of(config), "o": Provider.of(config | {"optional": True})})
    assert c.fetch("o", "one").first().body is None
    with pytest.raises(KeyError):
        c.fetch("p", "one")


def test_connection_timeout(spark):
    import socket

    from shapeloom.sources.http import call

    with socket.socket() as s:  # a full backlog takes no connection
        s.bind(("127.0.0.1", 0))
        s.listen(0)
        clients = [socket.socket() for _ in range(8)]
        for x in clients:
            x.setblocking(False)
            x.connect_ex(s.getsockname())
        began = time.perf_counter()
        assert call(f"http://127.0.0.1:{s.getsockname()[1]}/", {"timeout_ms": "20000", "connection_timeout_ms": "300", "optional": "true"}) == (None, None)
        assert time.perf_counter() - began < 5
        for x in clients:
            x.close()


def test_stateless_knows_nodes_from_names(spark, tmp_path):
    from shapeloom.streaming import open_stream, stateless

    spark.range(3).select(F.col("id").alias("Sort ")).write.parquet(f"file://{tmp_path}/t")
    stream = open_stream(spark, f"file://{tmp_path}/t", spark.read.parquet(f"file://{tmp_path}/t").schema)
    assert stateless(stream, lambda df: df.where("`Sort ` > 1")).isStreaming
    for state in (lambda df: df.distinct(), lambda df: df.groupBy("Sort ").count(), lambda df: df.limit(2)):
        with pytest.raises(ValueError, match="needs state"):
            stateless(stream, state)


def test_http_size(spark, server):
    from shapeloom.sources.http import register

    register(spark)
    with pytest.raises(Exception, match="more than 99 bytes"):
        spark.read.format("http_json").options(url=f"{server}/big", max_bytes=99).load().collect()
    assert spark.read.format("http_json").options(url=f"{server}/a\n{server}/b").load().count() == 2


def test_root_shapes(spark):
    bodies = ['[{"n":1},{"n":2}]', '{"e":[{"n":3}]}', '{"e":{"n":4}}', '{"n":5}', "42", "true", "null", "bad", None]
    df = parse_documents(spark.createDataFrame(list(enumerate(bodies)), "id int, body string"))
    n = lambda filtered: sorted((r.id, r.n) for r in elements(df, "e", filtered).select("id", J.lookup("element", "n", "int").alias("n")).collect())
    assert n(False) == [(0, 1), (0, 2), (1, 3), (2, 4), (3, 5)]
    assert n(True) == [(0, 1), (0, 2), (1, 3), (2, 4)]


def test_services(spark):
    s = Services()
    s.add("leaf", lambda c: spark.range(1).select(F.lit(c.param("a.b")).alias("x")))
    s.add("root", lambda c: c.service("leaf", a={"b": 3}).withColumn("y", F.col("x") + 1))
    s.add("loop", lambda c: c.service("loop2"))
    s.add("loop2", lambda c: c.service("loop"))
    assert tuple(s.run("root").first()) == (3, 4)
    assert Context(s).param("no.such") is None
    for bad in ("loop", "none"):
        with pytest.raises(ServiceError):
            s.run(bad)
    with pytest.raises(ServiceError):
        s.add("leaf", None)


@pytest.fixture(scope="module")
def requests(spark):
    rows = [
        (1, {"Authorization": "Bearer t"}, {}, {"page": "2"}, {"id": "5"}, "/p", "GET", '{"email":"a@b","name":"n"}'), (2, {}, {}, {"page": "x"}, {}, "/p", "GET", "[]"),
        (3, {"Authorization": "b"}, {}, {"page": "0"}, {"id": "9"}, "/p", "GET", '{"email":"a@b"}'), (4, {"Authorization": "b"}, {}, {"page": "1.5"}, {}, "/p", "GET", None),
    ]
    return spark.createDataFrame(rows, R.SCHEMA)


def test_validation(requests):
    page = validation.constraints(R.query("page"), "page", {"type": "integer", "minimum": 1})
    body = validation.body_rules(F.col("body"), {"required": ["email", "name"]})
    rules = [validation.required(R.header("Authorization"), "Authorization"), *page, *body]
    got = {r.request_id: r.error for r in validation.validate(requests, rules).collect()}
    assert got[1] is None and tuple(got[2]) == ("Authorization is required", 400, "VALIDATION_ERROR")
    assert got[3].error == "page breaks minimum 1" and got[4].error == "page is not of type integer"
    only_body = {r.request_id: r.error and r.error.error for r in validation.validate(requests, body).collect()}
    assert only_body == {1: None, 2: "body is not an object", 3: "body.name is required", 4: "body is required"}


def test_operation(requests):
    operation = {
        "parameters": [{"in": "header", "name": "Authorization", "required": True}, {"in": "query", "name": "page", "schema": {"$ref": "#/components/schemas/Page"}}],
        "requestBody": {"required": True, "content": {"application/json": {"schema": {"required": ["email", "name"]}}}},
    }
    rules = validation.operation_rules(operation, {"Page": {"type": "integer", "minimum": 1}})
    got = {r.request_id: r.error and r.error.error for r in validation.validate(requests, rules).collect()}
    assert got == {1: None, 2: "header Authorization is required", 3: "query page breaks minimum 1", 4: "query page is not of type integer"}


def test_constraints(spark):
    df = spark.createDataFrame([("é", "a@b", "red"), ("long text", "no", "blue")], "a string, e string, c string")
    rules = lambda x, s: [bool(r[0]) for r in df.select(validation.first_failure(validation.constraints(F.col(x), x, s)).isNotNull()).collect()]
    assert rules("a", {"minLength": 2, "maxLength": 4}) == [False, True] and rules("a", {"minLength": 3}) == [True, False]
    assert rules("e", {"format": "email"}) == [False, True] and rules("c", {"enum": ["red"]}) == [False, True] and rules("c", {"pattern": "e$"}) == [True, False]
    assert validation.resolve({"$ref": "#/components/schemas/X"}, {"X": {"type": "string"}}) == {"type": "string"}
    with pytest.raises(ValueError):
        validation.resolve({"$ref": "#/x/Y"}, {"Y": {"$ref": "#/x/Y"}})


def test_requests(spark, requests):
    table = spark.createDataFrame([(5, "five")], "id int, name string")
    assert {r.request_id: r.name for r in R.look_up(requests, table, R.param("id"), "id").collect()} == {1: "five", 2: None, 3: None, 4: None}
    a = spark.createDataFrame([(1, "x")], "request_id long, v string")
    assert {r.request_id: r.a and r.a.v for r in R.assemble(requests.select("request_id"), a=a).collect()} == {1: "x", 2: None, 3: None, 4: None}
    assert requests.where("request_id = 1").select(R.body_field("email"), R.cookie("c")).first()[0] == "a@b"


def test_responses(spark):
    df = spark.createDataFrame([(1, 1, "a"), (1, 2, None), (2, 1, "b")], "r int, o int, v string")
    bodies = {x.r: x.body for x in responses.collect_body(df, "r", "o", unwrap=True).collect()}
    assert bodies == {1: '[{"v":"a"},{"v":null}]', 2: '{"v":"b"}'}
    assert {x.r: x.body for x in responses.collect_body(df, "r", "o").collect()}[2] == '[{"v":"b"}]'
    r = spark.range(1).select(responses.http_error(404, "gone", "NOT_FOUND").alias("e"), responses.http_response(201, F.struct(F.lit(None).cast("int").alias("x")), {"L": "1"}).alias("k")).first()
    assert (r.e.status, json.loads(r.e.body)) == (404, {"error": "gone", "status": 404, "code": "NOT_FOUND"}) and (r.k.status, r.k.body, r.k.headers["L"]) == (201, '{"x":null}', "1")
    with pytest.raises(ValueError):
        responses.http_error(200, "no")
    with pytest.raises(Exception, match="stop"):
        spark.range(1).select(responses.fail("stop")).collect()


def test_errors(spark):
    from shapeloom.plans import errors

    want = {
        None: (errors.GENERIC, "INTERNAL_ERROR"), "context deadline exceeded": ("Request timeout", "UPSTREAM_TIMEOUT"), "user_service/profile: something failed": ("something failed", "INTERNAL_ERROR"),
        "failed to fetch https://internal.example.com/secret": ("failed to fetch [url]", "INTERNAL_ERROR"), "connection refused": ("Service temporarily unavailable", "UPSTREAM_UNAVAILABLE"),
        "network is unreachable": ("network is unreachable", "UPSTREAM_UNAVAILABLE"), "write tcp: broken pipe": ("Service temporarily unavailable", "INTERNAL_ERROR"), "auth_service/token: ": (errors.GENERIC, "INTERNAL_ERROR"),
        "dns server misbehaving": ("Service temporarily unavailable", "UPSTREAM_UNAVAILABLE"), "validation failed": ("validation failed", "INTERNAL_ERROR"), "context canceled": ("Request cancelled", "INTERNAL_ERROR"),
    }
    df = spark.createDataFrame([(k,) for k in want], "m string")
    assert {r.m: (r.s, r.c) for r in df.select("m", errors.safe_message("m").alias("s"), errors.code_of("m").alias("c")).collect()} == want
    assert (errors.code_of_status(400), errors.code_of_status(503)) == ("INVALID_REQUEST", "INTERNAL_ERROR")


def test_stream(spark, tmp_path):
    source = str(tmp_path / "in")
    spark.createDataFrame([(1, 5.0), (2, 50.0), (3, None)], "id int, v double").write.parquet(source)
    pipeline = lambda df: project(where_numbers(df, ("v", "<", 10)), {"id": "id", "twice": J.multiply("v", 2)})
    schema = spark.read.parquet(source).schema
    run = lambda: run_to_end(stateless(open_stream(spark, source, schema), pipeline), str(tmp_path / "out"), str(tmp_path / "c"))
    run()
    read = lambda: sorted(map(tuple, spark.read.parquet(str(tmp_path / "out")).collect()))
    assert read() == [(1, 10.0), (3, 0.0)] == sorted(map(tuple, pipeline(spark.read.parquet(source)).collect()))
    spark.createDataFrame([(4, 1.0)], "id int, v double").write.mode("append").parquet(source)
    run()
    assert read() == [(1, 10.0), (3, 0.0), (4, 2.0)]
    with pytest.raises(ValueError, match="state"):
        stateless(open_stream(spark, source, schema), lambda df: df.groupBy("id").count())
    with pytest.raises(ValueError, match="state"):
        stateless(spark.read.parquet(source), lambda df: order_by(df, "v", ordinal="id"))
