"""Operators on small hand-made tables: the cases that the registered queries don't reach."""

import json

import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from taintlake import schemas
from taintlake.functions import ids, rules, sqlrefs, text
from taintlake.operators import findings, projects, relational, reports, storage, taxonomy
from taintlake.plans.surface import ReadOnlyError, Surface
from taintlake.sources import files, records
from taintlake.streaming import findings as streams


def flow(spark, *rows):
    return spark.createDataFrame([(f, "T1", "K1", cwe, engine, [(file, line, line, None) for file, line in steps], "/s", conf) for f, cwe, engine, conf, steps in rows], schemas.TABLES["flows"])


TWO = [("a.js", 1), ("b.js", 9)]


def deduped(spark, *rows, **options):
    return {r.fid: (r.engine, r.confidence, r.merged) for r in findings.dedupe(flow(spark, *rows), **options).collect()}


def test_two_engines_collapse(spark):
    got = deduped(spark, ("F1", "CWE-89", "codeql", "definite", TWO), ("F2", "CWE-89", "semgrep", "inferred", TWO), ("F3", "CWE-79", "codeql", "inferred", TWO))
    assert got == {"F1": ("codeql+semgrep", "definite", 2), "F3": ("codeql", "inferred", 1)}


def test_consensus_raises_confidence(spark):
    assert deduped(spark, ("F1", "C", "codeql", "inferred", TWO), ("F2", "C", "semgrep", "inferred", TWO))["F1"][1] == "definite"
    three = deduped(spark, ("F1", "C", "codeql", "llm-suggested", TWO), ("F2", "C", "joern", "llm-suggested", TWO), ("F3", "C", "semgrep", "inferred", TWO))
    assert three == {"F3": ("codeql+joern+semgrep", "definite", 3)}
    assert deduped(spark, ("F1", "C", "codeql", None, TWO), ("F2", "C", "semgrep", "odd", TWO)) == {"F1": ("codeql+semgrep", "llm-suggested", 2)}
    assert deduped(spark, ("F1", "C", "codeql", "inferred", TWO), ("F2", "C", None, "inferred", TWO), ("F3", "C", "", "inferred", TWO)) == {"F1": ("codeql", "inferred", 3)}


def test_missing_and_empty_cwe_are_one(spark):
    assert len(deduped(spark, ("F1", None, "codeql", "inferred", TWO), ("F2", "", "semgrep", "inferred", TWO))) == 1


def test_flows_of_one_step(spark):
    rows = ("F1", "C", "codeql", "inferred", [("a.js", 1)]), ("F2", "C", "codeql", "inferred", [("b.js", 2)])
    assert len(deduped(spark, *rows)) == 2
    assert len(deduped(spark, *rows, compat=True)) == 1
    assert deduped(spark) == {}


def test_last_write_wins_and_is_idempotent(spark):
    ddl = "k int, v string, ord int"
    old, new = spark.createDataFrame([(1, "a", 0), (2, "b", 0)], ddl), spark.createDataFrame([(2, "c", 1), (2, None, 2), (3, "d", 1)], ddl)
    once = relational.upsert(old, new, ["k"], "ord")
    assert {(r.k, r.v) for r in once.collect()} == {(1, "a"), (2, None), (3, "d")}
    assert sorted(map(tuple, relational.upsert(once, new, ["k"], "ord").collect())) == sorted(map(tuple, once.collect()))


def test_append_replaces_a_project(spark):
    ddl = "p string, v int"
    old, new = spark.createDataFrame([("a", 1), ("b", 2)], ddl), spark.createDataFrame([("a", 3)], ddl)
    assert {tuple(r) for r in relational.replace_project(old, new, "p").collect()} == {("b", 2), ("a", 3)}


@pytest.mark.parametrize("others, left", [([], {1, 2, None}), ([2], {1}), ([2, None], set()), ([None], set())])
def test_not_in(spark, others, left):
    rows = spark.createDataFrame([(1,), (2,), (None,)], "k int")
    got = relational.not_in(rows, "k", spark.createDataFrame([(o,) for o in others], "v int"), "v")
    assert {r.k for r in got.collect()} == left


def test_nearest_across_bands(spark):
    left = spark.createDataFrame([(1, "f", 200), (2, "f", 1000), (3, "g", 5)], "id int, file string, line int")
    right = spark.createDataFrame([(7, "f", 199), (8, "f", 201), (9, "f", 801), (10, "f", 1200)], "rid int, file string, line int")
    got = {(r.id, r.near_rid, r.distance) for r in relational.nearest(left, right, ["file"], "line", "line", ["id"], ["rid"], 200).collect()}
    assert got == {(1, 7, 1), (2, 9, 199)}


def test_reachability_stops(spark):
    edges = spark.createDataFrame([(i, (i + 1) % 5) for i in range(5)], "src int, dst int")
    got = {(r.node, r.steps) for r in relational.reachable(edges, spark.createDataFrame([(0,)], "node int"), 99).collect()}
    assert got == {(i, i) for i in range(5)}


CALLEES = [
    ("app.get", "a.ts", "http_route"), ("APP.Delete", "a.js", "http_route"), ("router.route", "x.mjs", "http_route"), ("@Controller('u')", "a.ts", "http_route"), ("button.on", "a.js", None),
    ("socket.on", "a.js", "listener"), ("el.addEventListener", "a.js", "listener"), ("cron.schedule", "a.js", "cron"), ("process.argv", "a.js", "cli"), ("queue.process", "a.js", "message_consumer"), ("console.log", "a.js", None),
    ("@app.route", "a.py", "http_route"), ("path", "p/urls.py", "http_route"), ("path", "p/views.py", None), ("@celery.task", "a.py", "message_consumer"), ("sys.argv", "a.pyi", "cli"),
    ("@GetMapping(\"/u\")", "A.java", "http_route"), ("@Path", "A.java", "http_route"), ("@KafkaListener", "A.java", "message_consumer"), ("@Scheduled", "A.java", "cron"), ("@Override", "A.java", None),
    ("http.HandleFunc", "m.go", "http_route"), ("r.GET", "m.go", "http_route"), ("nc.Subscribe", "m.go", "message_consumer"), ("flag.Parse", "m.go", "cli"), ("fmt.Println", "m.go", None),
    ("resources :u", "config/routes.rb", "http_route"), ("resources :u", "app/x.rb", None), ("get '/x'", "app.rb", "http_route"), ("include Sidekiq::Worker", "j.rb", "message_consumer"), ("ARGV", "t.rake", "cli"),
    ("Route::get", "r.php", "http_route"), ("$app->post", "r.php", "http_route"), ("#[Route('/x')]", "c.php", "http_route"), ("add_action(", "w.php", "http_route"), ("WP_CLI::add_command", "w.php", "cli"),
    ("[HttpGet]", "C.cs", "http_route"), ("app.MapGroup", "P.cs", "http_route"), ("[FunctionName(\"x\")]", "F.cs", "http_route"), ("[Obsolete]", "C.cs", None),
    ("get(\"/u\")", "R.kt", "http_route"), ("map.get(\"u\")", "R.kt", None), ("routing {", "R.kts", "http_route"), ("@RestController", "R.kt", "http_route"),
    ("getopts", "a.sh", "cli"), ("eval \"$x\"", "a.bash", "cli"), ("echo", "a.sh", None), ("on: push", "w.yml", "http_route"), ("run: make", "w.yaml", "cli"), ("${{ github.event.issue.title }}", "w.yml", "cli"), ("name: x", "w.yml", None),
]


def test_entrypoint_kinds(spark):
    rows = spark.createDataFrame([(i, c, f) for i, (c, f, _) in enumerate(CALLEES)], "i int, callee string, file string")
    got = {r.i: r.k for r in rows.select("i", rules.entrypoint_kind(F.col("callee"), F.col("file")).alias("k")).collect()}
    assert {CALLEES[i][:2]: k for i, k in got.items()} == {(c, f): k for c, f, k in CALLEES}


CALLS = [
    ("db.query", "sql_column", "unknown"), ("tx.ExecContext", "sql_column", "unknown"), ("$wpdb->get_results", "sql_column", "unknown"), ("mysqli_multi_query", "sql_column", "unknown"), ("cmd.ExecuteReaderAsync", "sql_column", "unknown"),
    ("redis.setex", "cache_key", "write"), ("client.get", "cache_key", "read"), ("rdb.HGetAll", "cache_key", "read"), ("kafka.send", "queue_topic", "write"), ("worker.process", "queue_topic", "read"),
    ("sqlx.Get", "sql_column", "unknown"), ("fs.readFile", None, None), ("db.queryish", None, None), ("cache.getter", None, None),
]


def test_storage_calls(spark):
    rows = spark.createDataFrame([(c,) for c, *_ in CALLS], "c string").withColumn("s", rules.storage_call(F.col("c")))
    assert {r.c: (r.s and r.s.kind, r.s and r.s.op) for r in rows.collect()} == {c: (k, o) for c, k, o in CALLS}


def test_file_entrypoints(spark):
    rows = [("s1", "/r/pages/api/u.ts", "x", 4, 1), ("s2", "/r/app/u/route.ts", "GET", 2, 2), ("s3", "/r/app/routes/a.tsx", "loader", 7, 3), ("s4", "/r/app/routes/a.tsx", "action", 9, 4), ("s5", "/r/lib/a.ts", "loader", 1, 5)]
    got = findings.file_entrypoints(spark.createDataFrame(rows, "id string, file string, display_name string, range_start int, ord int"))
    assert {(r.symbol_id, r.signature, r.line) for r in got.collect()} == {("s1", "next:u.ts", 1), ("s2", "next:route.ts", 1), (None, "remix:a.tsx", 7)}


SQL = [
    ("SELECT bio FROM users", "read", ["sql:users.bio"]),
    ("select U.Bio, p.title from Users u join posts p on p.uid = u.id", "read", ["sql:posts.title", "sql:posts.uid", "sql:users.bio", "sql:users.id"]),
    ("UPDATE users SET bio = ? WHERE id = 5", "write", ["sql:users.bio", "sql:users.id"]),
    ("INSERT INTO t (a, b) VALUES (1, 'select x from y')", "write", ["sql:t.a", "sql:t.b"]),
    ("SELECT count(*) FROM t", "read", []),
    ("hello from the world", None, []),
    ("VACUUM", None, []),
    ("", None, []),
    (None, None, []),
]


@pytest.mark.parametrize("sql, op, columns", SQL)
def test_sql_references(sql, op, columns):
    assert (sqlrefs.operation(sql), sqlrefs.columns(sql)) == (op, columns)


@given(st.text(max_size=60))
def test_sql_references_never_fail(sql):
    assert sqlrefs.operation(sql) in (None, "read", "write")
    for s in (sql, f"SELECT {sql} FROM t", f"SELECT a FROM {sql}"):
        assert all(c == c.lower() and c.startswith("sql:") for c in sqlrefs.columns(s))


def test_verbs_agree_with_the_parser(spark):
    parser = spark._jsparkSession.sessionState().sqlParser()
    for sql, op, _ in SQL[:5]:
        name = parser.parsePlan(sql.replace("?", "'v'")).getClass().getSimpleName()
        assert op == ("write" if name in ("InsertIntoStatement", "UpdateTable") else "read")


def test_taint_through_storage(spark):
    code = 'const a = db.query("SELECT bio FROM users")\nconst b = `SELECT name FROM other`\n'
    flows = spark.createDataFrame([("F1", "T1", "K1", "CWE-79", "joern", [("UPDATE users SET bio = ? WHERE id = 1", 0, 0, None), ("w.js", 3, 3, None)], "", "inferred"), ("F2", "T2", "K9", None, "joern", [("x.js", 1, 1, None)], "", "inferred")], schemas.TABLES["flows"])
    sources = spark.createDataFrame([("T1", None, "http", "k", "in.js:4"), ("T2", None, "http", "k", None)], schemas.TABLES["taint_sources"])
    sinks = spark.createDataFrame([("K1", None, "sql.exec", "pg", "", []), ("K9", None, "sql_column", "pg", "", [])], schemas.TABLES["taint_sinks"])
    texts = spark.createDataFrame([("r.js", code)], "path string, content string")
    state = storage.fixpoint(flows, sources, sinks, texts)
    assert {r.storage_id for r in state["storage_locations"].collect()} == {"sql:users.bio", "sql:users.id", "sql:unknown.K9"}
    assert {(r.storage_id, r.symbol_id) for r in state["storage_reads"].collect()} == {("sql:users.bio", "read:r.js:1")}
    new = [r for r in state["flows"].collect() if r.engine == "storage-taint-r2"]
    assert [(r.cwe, r.confidence, [s.file for s in r.steps]) for r in new] == [("CWE-79", "inferred", ["in.js:4", "w.js", "read:r.js:1"])]
    assert state["rounds"] == 2 and state["converged"]
    assert not storage.fixpoint(flows, sources, sinks, texts, max_rounds=1)["converged"]
    again = storage.fixpoint(state["flows"], state["taint_sources"], state["taint_sinks"], texts)
    assert again["flows"].count() == state["flows"].count()


def test_suggested_keys(spark):
    texts = spark.createDataFrame([("a.js", "x\ncache.get(`user:${id}:profile`)\ncache.set(`user:1:profile`)\n")], "path string, content string")
    keys = spark.createDataFrame([("cache:user:*:profile", "cache_key", 0.9), ("cache:other", "cache_key", 0.2)], "storage_id string, kind string, confidence double")
    got = storage.dynamic_reads(texts, keys, schemas.empty(spark, "storage_reads")).collect()
    assert [(r.storage_id, r.symbol_id) for r in got] == [("cache:user:*:profile", "read:a.js:2")]


@given(st.text(alphabet="ab.:*[](\\^$", min_size=1, max_size=12))
def test_key_patterns_hold_their_own_text(key):
    import re

    rest = key.partition(":")[2] or key
    pattern = "[^`'\"\\s]*".join(map(re.escape, rest.split("*")))
    assert re.search(pattern, rest.replace("*", "x"))


def test_calls_whose_cut_ids_clash_all_stay(spark):
    paths = ["d/e326052.js", "d/e416770.js", "d/e2.js"]
    texts = spark.createDataFrame([(p, "a\n  cache.get(`u:${id" + p[3:-3] + "}`)\nb") for p in paths], "path string, content string")
    calls = spark.createDataFrame([("call", p, 2) for p in [*paths, paths[0]]], "kind string, file string, line int")
    got = storage.unresolved_calls(calls, texts).collect()
    assert sorted(r.file for r in got) == sorted(paths) and len({r.call_id for r in got}) == 2


def test_round_two_counts_before_it_meets_locations(spark):
    """Ties of CWEs go to the first flow; a first write without a flow, and flows that are there, are passed over; no text is compared over locations x flows."""
    at = lambda fid, tid, cwe, file: (fid, tid, "K", cwe, "codeql", [("a.js", 1, 1, None), (file, 2, 2, None)], "/s", "definite")
    flows = spark.createDataFrame([at("F3", "T1", "CWE-2", "x.js"), at("F4", "T2", "CWE-1", "y.js"), at("F5", "T2", "CWE-2", "z.js"), at("F2", "T1", "CWE-1", "w.js"), at("F6", "T3", None, "v.js")], schemas.TABLES["flows"])
    sources = spark.createDataFrame([("T1", None, "c", "k", "a.js:1")], schemas.TABLES["taint_sources"])
    writes = spark.createDataFrame([("s1", "F0", "T1", None, None), ("s1", "F4", "T2", None, None), ("s1", "F3", "T1", None, None), ("s2", "F5", "T2", None, None), ("s3", "F6", "T3", None, None)], schemas.TABLES["storage_writes"])
    reads = spark.createDataFrame([(s, "read:r.js:1", None) for s in ("s1", "s2", "s3")], schemas.TABLES["storage_reads"])
    taint = spark.createDataFrame([("s1", "D1", ["T1", "T2"], "definite"), ("s2", "D2", ["T2"], "definite"), ("s3", "D3", ["T3"], "definite")], schemas.TABLES["storage_taint"])
    relational.ensure_checkpoint_dir(spark)
    made = storage.round_two(taint, reads, writes, flows, sources)
    assert "partial_count(1), partial_min(fid" not in made._jdf.queryExecution().toString()
    got = {r.tid: (r.cwe, r.steps[0].file, r.steps[1].file) for r in made.collect()}
    assert got == {"D1": ("CWE-1", "a.js:1", "x.js"), "D2": ("CWE-1", "s2", "z.js"), "D3": ("", "s3", "v.js")}
    there = made.where("tid = 'D2'").union(flows).checkpoint()
    assert {r.tid for r in storage.round_two(taint, reads, writes, there, sources).collect()} == {"D1", "D3"}


def test_proposals_merge_first_and_sure(spark):
    p = spark.createDataFrame([("s1", "cache_key", 0.9, "why", "c1", 1), ("s1", "queue", 0.8, "why", "c2", 2), ("s2", "cache_key", 0.3, "", "c3", 3), ("s0", "cache_key", 1.0, "", "c4", 4)], "storage_id string, kind string, confidence double, rationale string, call_id string, ord int")
    old = spark.createDataFrame([("s0", "x", 1.0, "", "c")], "storage_id string, kind string, confidence double, rationale string, call_id string")
    assert {(r.storage_id, r.kind) for r in storage.merge_proposals(old, p).collect()} == {("s0", "x"), ("s1", "cache_key")}


def place(uri, a, b=None):
    return dict(physicalLocation=dict(artifactLocation=dict(uri=uri), region=dict(startLine=a) | (dict(endLine=b) if b else {})))


def test_sarif(spark, tmp_path):
    rule = dict(id="js/sqli", properties=dict(tags=["external/cwe/cwe-089"]))
    thread = dict(locations=[dict(location=place("a.js", 2)), dict(location=place("file:///abs/b.js", 9, 11))])
    result = lambda rule_id, where, **more: dict(ruleId=rule_id, message=dict(text="m"), locations=where, **more)
    found = [result("js/sqli", [place("a.js", 9)], codeFlows=[dict(threadFlows=[thread])]), result("pattern/CWE-79", [place("c.js", 5)]), result("nothing", [])]
    doc = dict(runs=[dict(tool=dict(driver=dict(name="x", rules=[rule])), results=found)])
    (tmp_path / "x.sarif").write_text(json.dumps(doc))
    got = records.sarif_rows(records.sarif(spark, str(tmp_path / "x.sarif")), "p", "/root", "codeql")
    flows = sorted(got["flows"].collect(), key=lambda r: r.cwe)
    assert [(r.cwe, [(s.file, s.start, s.end) for s in r.steps]) for r in flows] == [("CWE-79", [("/root/c.js", 5, 5)]), ("CWE-89", [("/root/a.js", 2, 2), ("/abs/b.js", 9, 11)])]
    assert {r["class"] for r in got["taint_sinks"].collect()} == {"pattern", "js/sqli"}
    assert {r.evidence_loc for r in got["taint_sources"].collect()} == {"/root/a.js:2", "/root/c.js:5"}
    twice = findings.index_update(got["flows"], got["flows"].withColumn("o", F.lit(1)), "flows", "o")
    assert twice.count() == 2


def test_queue_does_not_gather_flows_by_cwe(spark):
    from taintlake.plans import catalog

    plan = catalog.QUERIES["nomination_queue"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin [cwe" not in plan and "BroadcastHashJoin [cwe" in plan


@pytest.mark.parametrize("name", ["sarif_flows", "sarif_sources"])
def test_sarif_documents_are_read_once(spark, name):
    from taintlake.plans import catalog

    plan = catalog.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("from_json(") == 1


def test_json_lines_of_all_kinds(spark, tmp_path):
    lines = ["", "not json", '{"fid": null, "source_file": "a.js", "source_line": 1, "sink_file": "/x/b.js", "sink_line": 2, "source_name": "s", "sink_name": "k", "cwe": "CWE-78", "sink_class": "shell"}', "[1]", '{"fid": "F9", "source_file": ']
    (tmp_path / "g.jsonl").write_text("\n".join(lines))
    rows = records.graph_flow_rows(records.jsonl(spark, str(tmp_path / "g.jsonl"), schemas.GRAPH_FLOWS), "/r")
    (one,) = rows["flows"].collect()
    assert one.fid.startswith("joern-") and [s.file for s in one.steps] == ["/r/a.js", "/x/b.js"] and one.confidence == "inferred"
    (tmp_path / "m.jsonl").write_text('{"cwe": "CWE-1", "source": {"file": "a", "line": 1, "class": "c"}, "sink": {"file": "b", "line": 2, "class": "d"}, "steps": [{"file": "a", "line": 1}]}')
    (model,) = records.model_flow_rows(records.jsonl(spark, str(tmp_path / "m.jsonl"), schemas.MODEL_FLOWS))["flows"].collect()
    assert model.engine == "llm-heavy" and model.confidence == "inferred" and model.steps[0].start == 1
    ast = [dict(type="file", file="a.ts", lang="ts", lineCount=3), dict(type="symbol", file="a.ts", kind="function", name="f", range=[1, 2], syntheticId="s1"), dict(type="symbol", file="a.ts", name="lost"), {"type": "xref", "file": "a.ts", "kind": "call", "line": 2, "calleeText": "app.get"}, {"type": "done"}]
    (tmp_path / "a.jsonl").write_text("\n".join(map(json.dumps, ast)))
    made = records.ast_rows(records.jsonl(spark, str(tmp_path / "a.jsonl"), schemas.AST), "p", records.scip_symbols(spark.createDataFrame([("a.ts", [0, 1, 1, 4], "better")], "file string, range array<int>, symbol string")))
    assert [r.id for r in made["symbols"].collect()] == ["better"] and [r.callee_text for r in made["xrefs"].collect()] == ["app.get"]
    (tmp_path / "e.jsonl").write_text('{"type": "error"}')
    with pytest.raises(ValueError):
        records.ast_rows(records.jsonl(spark, str(tmp_path / "e.jsonl"), schemas.AST), "p")


def test_manifest_of_a_tree(spark, tmp_path):
    for name, body in (("a.js", "1"), ("src/b.js", "2"), ("node_modules/c.js", "3"), (".git/d", "4")):
        (tmp_path / "t" / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "t" / name).write_text(body)
    old = files.build_manifest(spark, str(tmp_path / "t"))
    assert {(r.path, r.size) for r in old.collect()} == {("a.js", 1), ("src/b.js", 1)}
    files.write_jsonl(old, str(tmp_path / "m"))
    kept = files.read_manifest(spark, str(tmp_path / "m"))
    assert files.unchanged(kept, old)
    (tmp_path / "t/a.js").write_text("5")
    (tmp_path / "t/new.js").write_text("6")
    new = files.build_manifest(spark, str(tmp_path / "t"))
    assert {(r.path, r.change) for r in findings.manifest_diff(kept, new).collect()} == {("a.js", "modified"), ("new.js", "added")}
    assert not files.unchanged(kept, new)


def test_headings_above_nominations(spark):
    md = ["## Stream A", "- [ ] N-1 | p | v | l:1 | rec: high | y/n: y", "text", "## Stream C", "- [x] N-2 | p | v | l:2 | rec: med | y/n:"]
    got = records.nominations(spark.createDataFrame(list(enumerate(md)), "n int, value string")).collect()
    assert [(r.id, r.heading, r.decision) for r in got] == [("N-1", "Stream A", "y"), ("N-2", "Stream C", "")]
    f = records.finding(F.lit("---\nfinding_id: F-1\nstatus: verified\ntitle: 'A b'\n---\nbody\n"))
    row = spark.range(1).select(*[c.alias(k) for k, c in f.items()]).first()
    assert (row.finding_id, row.status, row.title, row.body, row.cwe) == ("F-1", "verified", "A b", "body\n", None)


def test_projects(spark):
    paths = ["package.json", "pnpm-lock.yaml", "api/pyproject.toml", "api/sub/requirements.txt", "svc/go.mod", "svc/main.go"]
    got = {(r.kind, r.dir, r.manifest, r.package_manager) for r in projects.detect(spark.createDataFrame([(p,) for p in paths], "path string")).collect()}
    assert got == {("node", "", "package.json", "pnpm"), ("python", "api", "pyproject.toml", "unknown"), ("go", "svc", "go.mod", "go")}
    bare = {(r.kind, r.dir) for r in projects.detect(spark.createDataFrame([("x/a.sh",), ("b.rb",)], "path string")).collect()}
    assert bare == {("bash", ""), ("ruby", "")}


def test_project_tiers(spark):
    """Manifests, then configuration at the root, then bare sources, then pages."""
    of = lambda *paths: {(r.kind, r.dir, r.package_manager) for r in projects.detect(spark.createDataFrame([(p, c) for p, c in paths], "path string, content string")).collect()}
    none = lambda *paths: of(*[(p, None) for p in paths])
    assert of(("k/pod.yaml", "apiVersion: v1\nkind: Pod"), (".github/workflows/ci.yml", ""), ("a.sh", "")) == {("yaml", "", "unknown")}
    assert of(("k/pod.yaml", "a: b"), ("a.sh", ""), ("b.rb", ""), ("i.html", "")) == {("bash", "", "unknown"), ("ruby", "", "unknown")}
    assert none("i.html", "j.css") == {("html", "", "unknown")}
    shared = of(("package.json", '{"workspaces": ["a"]}'), ("yarn.lock", ""), ("a/package.json", "{}"), ("b/c/package.json", "{}"), ("b/c/setup.py", ""), ("Chart.yaml", ""))
    assert shared == {("node", "a", "yarn"), ("node", "b/c", "yarn"), ("yaml", "", "unknown")}
    mixed = none("s.sln", "a/A.csproj", "a/b/B.csproj", "c/C.csproj", "w/core/lib/Drupal.php", "g/go.work", "g/go.mod", "j/build.gradle.kts", "j/m/pom.xml", "only/x.sln")
    assert mixed == {("csharp", "a", "nuget"), ("csharp", "c", "nuget"), ("csharp", "only", "nuget"), ("php", "w", "unknown"), ("go", "g", "go-workspace"), ("java", "j", "gradle-kts")}


def test_project_names_and_languages(spark):
    files = spark.createDataFrame([
        ("n/package.json", '{"version": "1", "name": "@x/app"}'), ("n/a.tsx", ""), ("p/pyproject.toml", "[build]\nname = 'no'\n[project]\nversion = '1'\nname = \"pkg\"\n"), ("j/build.gradle", ""), ("j/settings.gradle", "rootProject.name = 'jar'"), ("j/a.kt", ""), ("j/b.kts", ""), ("j/C.java", ""),
        ("g/go.mod", "module example.org/o/tool\n\ngo 1.2"), ("r/x.gemspec", "s.name = 'gem'"), ("h/composer.json", '{"name": "v/site"}'), ("c/App.csproj", "<Project/>"), ("d/D.csproj", "<RootNamespace> Root.D </RootNamespace>"), ("q/setup.py", "setup()"),
    ], "path string, content string")
    found = projects.detect(files)
    names = {(r.kind, r.dir): r.name for r in projects.project_names(found, files, "top").collect()}
    assert names == {("node", "n"): "@x/app", ("python", "p"): "pkg", ("java", "j"): "jar", ("go", "g"): "tool", ("ruby", "r"): "gem", ("php", "h"): "site", ("csharp", "c"): "App", ("csharp", "d"): "Root.D", ("python", "q"): "q"}
    langs = {(r.kind, r.dir): r.languages for r in projects.project_languages(found, files).collect()}
    assert langs["node", "n"] == ["typescript"] and langs["java", "j"] == ["java", "kotlin"] and langs["go", "g"] == []
    read = {(r.kind, r.dir): r.a for r in projects.project_languages(found, files).select("kind", "dir", projects.analyzed_language(F.col("kind"), F.col("languages")).alias("a")).collect()}
    assert read["node", "n"] == "javascript" and read["java", "j"] == "java" and read["go", "g"] is None
    counts = projects.files_per_language(files.select(F.split_part("path", F.lit("/"), F.lit(1)).alias("project"), "path"), ["project"]).where("project = 'j'").collect()
    assert {(r.language, r.files, r.jvm) for r in counts} == {("kotlin", 2, "kotlin"), ("java", 1, "kotlin")}
    assert [r.dir for r in projects.by_path(found).collect()] == sorted(r.dir for r in found.collect())


def test_files_and_sidecars(spark, tmp_path):
    import hashlib
    import os

    for name, text in (("a/b.js", "x"), ("build/c.py", "y"), (".git/d", "z"), ("a/node_modules/e.js", "w"), ("f.kts", "v")):
        path = tmp_path / "src" / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(text)
    os.symlink(tmp_path / "src/f.kts", tmp_path / "src/link.kt")
    rows = files.build_manifest(spark, str(tmp_path / "src")).collect()
    assert {(r.path, r.sha256, r.size) for r in rows} == {(p, hashlib.sha256(t.encode()).hexdigest(), 1) for p, t in (("a/b.js", "x"), ("build/c.py", "y"), ("f.kts", "v"))}
    assert {r.path.rpartition("/")[2] for r in files.read_texts(spark, str(tmp_path / "src"), (".js", ".kts")).collect()} == {"b.js", "f.kts"}
    listed = {(r.kind, r.path) for r in files.file_lists(spark.createDataFrame([(p,) for p in ("a/b.js", "build/C.java", "x/C.java", "vendor/a.rb", "a.rake", "venv/x.py", "q.yml", "i.htm", "b.kts", "obj/a.cs", "s.sh")], "path string")).collect()}
    assert listed == {("ts", "a/b.js"), ("java", "x/C.java"), ("ruby", "a.rake"), ("yaml", "q.yml"), ("html", "i.htm"), ("kotlin", "b.kts"), ("bash", "s.sh")}
    sizes = {(r.folder, r.files, r.size) for r in files.folder_sizes(spark.createDataFrame([("a/b/c", 3), ("a/d", 4), ("e", 5)], "path string, size long")).collect()}
    assert sizes == {("", 3, 12), ("a", 2, 7), ("a/b", 1, 3)}
    records = spark.createDataFrame([("/r/x/a.js", "2"), ("/r/x/a.js", "1"), ("/else/b.py", "3")], "file string, record string")
    for _ in range(2):
        done = {(r.path, r.records) for r in files.write_sidecars(records, "/r", str(tmp_path / "side")).collect()}
    assert done == {("x/a.js.enrich.jsonl", 2), ("b.py.enrich.jsonl", 1)}
    assert (tmp_path / "side/x/a.js.enrich.jsonl").read_text() == "1\n2\n" and sorted(p.name for p in tmp_path.glob("side/**/*") if p.is_file()) == ["a.js.enrich.jsonl", "b.py.enrich.jsonl"]


def test_scip_index(spark, tmp_path):
    def field(n, value):
        number = lambda x: bytes([x & 127 | 128, *number(x >> 7)]) if x > 127 else bytes([x])
        return number(n << 3) + number(value) if isinstance(value, int) else number(n << 3 | 2) + number(len(value)) + value

    spots = field(2, field(1, bytes([4, 0, 7])) + field(2, b"pkg f().")) + field(2, field(1, 9) + field(1, 1) + field(1, 200) + field(1, 3) + field(3, 1))
    (tmp_path / "i.scip").write_bytes(field(1, b"meta") + field(2, field(1, b"a.ts") + field(4, b"typescript") + spots) + field(2, field(1, b"empty.ts")))
    got = records.scip(spark, str(tmp_path / "i.scip"))
    assert [tuple(r) for r in got.collect()] == [("a.ts", [4, 0, 7], "pkg f()."), ("a.ts", [9, 1, 200, 3], "")]
    assert {tuple(r) for r in records.scip_symbols(got.where("symbol != ''")).collect()} == {("a.ts", 5, 5, "pkg f().")}


def test_graph_calls(spark):
    from taintlake.functions import graph_rules
    from taintlake.operators import graph_calls

    assert len(graph_rules.rules()) == 128
    rows = [("javascript", "a.js", 10, "send", "res.send(x)"), ("javascript", "a.js", 12, "send", "queue.send(x)"), ("js", "a.js", 4, "body", "req.body.name"), ("ts", "a.js", 300, "query", "db.query(q)"), ("golang", "b.go", 9, "Query", "db.Query(q)"),
            ("go", "b.go", 5, "Query", 'c.Query("id")'), ("python", "c.py", 3, "Popen", "subprocess.Popen(c)"), ("php", "d.php", 8, "ECHO", "echo $x"), ("php", "d.php", 9, "shell_exec", "shell_exec($_GET['c'])"), ("php", "d.php", 2, "x", "$_GET['c']"), ("ruby", "e.rb", 1, "wherever", "")]
    calls = spark.createDataFrame(rows, "language string, file string, line int, name string, code string")
    sinks = {(r.file, r.line, r.cwe, r.sink_class) for r in graph_calls.sink_calls(calls).collect()}
    assert sinks == {("a.js", 10, "CWE-79", "html.write"), ("a.js", 300, "CWE-89", "sql.exec"), ("b.go", 9, "CWE-89", "sql.exec"), ("b.go", 5, "CWE-89", "sql.exec"), ("c.py", 3, "CWE-78", "cmd.shell"), ("d.php", 9, "CWE-78", "cmd.shell")}
    assert {(r.file, r.line) for r in graph_calls.source_calls(calls).collect()} == {("a.js", 4), ("b.go", 5), ("d.php", 2)}
    paths = spark.createDataFrame([("b.go", 5, "b.go", 5, "s", "Query", "CWE-89", "sql.exec"), ("b.go", 5, "b.go", 9, "s", "Query", "CWE-89", "sql.exec"), ("b.go", 5, "b.go", 9, "s", "Query", "CWE-89", "sql.exec")], "source_file string, source_line int, sink_file string, sink_line int, source_name string, sink_name string, cwe string, sink_class string")
    traced = graph_calls.traced_flows(paths)
    assert [(r.source_line, r.sink_line) for r in traced.collect()] == [(5, 9)]
    near = {(r.source_file, r.source_line, r.sink_line, r.cwe) for r in graph_calls.near_flows(calls, traced).collect()}
    assert near == {("a.js", 4, 10, "CWE-79"), ("d.php", 2, 9, "CWE-78")}
    code = "const k = process.env.KEY;\nif (k === given) {}\nif (timingSafeEqual(k, g) == true) {}\nif (x != process.env['T']) {}\nconst j = 1; if (j == 2) {}"
    found = graph_calls.secret_compares(spark.createDataFrame([("a.ts", code), ("b.py", code)], "path string, content string")).collect()
    assert {(r.path, r.line, r.cwe) for r in found} == {("a.ts", 2, "CWE-208"), ("a.ts", 4, "CWE-208")}


def test_documents_of_markdown(spark):
    entries = spark.createDataFrame([("http_route", "b", 2, "get /"), ("http_route", "a", 9, "post"), ("cli", "c", 1, "argv"), ("odd", "d", 1, "x")], "kind string, file string, line int, signature string").withColumn("symbol_id", F.lit(None).cast("string"))
    text = reports.entrypoints_markdown(findings.ordered_entrypoints(entries), "t").first().markdown
    assert text == "# Entrypoints: t\n\n## http_route\n\n- `post` at `a:9`\n- `get /` at `b:2`\n\n## cli\n\n- `argv` at `c:1`\n"
    assert reports.entrypoints_markdown(findings.ordered_entrypoints(entries.where("false")), "t").first().markdown == "# Entrypoints: t\n\nNo entrypoints detected.\n"
    p = spark.createDataFrame([("n", "", "node", ["ts", "js"], [], "npm", True, False)], "name string, dir string, kind string, languages array<string>, frameworks array<string>, package_manager string, has_tsconfig boolean, workspace_member boolean")
    assert "- Path: `.`\n- Kind: node\n- Languages: js, ts\n- Frameworks: \u2014\n- Package manager: npm\n- TS config: yes\n- Workspace member: no\n" in reports.repository_markdown(p, "r").first().markdown
    q = spark.createDataFrame([("N2", "p", "v", "a:1"), ("N1", "p q", "w", "b:2")], "id string, project string, vector string, loc string")
    text = reports.queue_markdown(q).first().markdown
    assert text == "# Findings queue\n\n- [ ] N1 | p q | w | b:2\n- [ ] N2 | p | v | a:1\n"
    back = records.queue(spark.createDataFrame([(x,) for x in text.split("\n")], "value string"))
    assert {tuple(r) for r in back.collect()} == {tuple(r) for r in q.collect()}
    f = spark.createDataFrame([("F1", "N", "fl", None, "verified", "it's: \"x\"", "body\n---\nmore")], "finding_id string, nomination_id string, flow_id string, cwe string, status string, title string, body string")
    md = reports.finding_markdown(f)
    got = md.select(*[c.alias(k) for k, c in records.finding(F.col("markdown")).items()]).first()
    assert (got.finding_id, got.cwe, got.status, got.title, got.body) == ("F1", None, "verified", "it's: \"x\"", "body\n---\nmore")
    for bad in ("no front", "---\nstatus: odd\n---\nx"):
        with pytest.raises(Exception, match="front matter|unknown status"):
            spark.createDataFrame([(bad,)], "t string").select(records.finding(F.col("t"))["status"]).collect()
    assert reports.text_table(spark.createDataFrame([(1, None), (200, "x")], "a int, name string").orderBy("a")) == "  a  name\n  1      \n200     x"
    assert reports.text_table(spark.createDataFrame([], "a int")) == "(no rows)"


def test_suggestions_in_a_file(spark, tmp_path):
    path = str(tmp_path / "s.yml")
    assert taxonomy.read_suggested(spark, path).count() == 0
    (tmp_path / "s.yml").write_text("own: {a: 1}\nllm_suggested:\n  s0: {kind: x, confidence: 1.0}\n")
    p = spark.createDataFrame([("c1", "s1", "cache_key", 0.9, "why", 1), ("c2", "s2", "k", 0.1, "", 2), ("c3", "s0", "k", 0.9, "", 3)], "call_id string, storage_id string, kind string, confidence double, rationale string, ord int")
    assert taxonomy.write_suggested(storage.merge_proposals(taxonomy.read_suggested(spark, path), p), path) == 2
    assert {(r.storage_id, r.kind) for r in taxonomy.read_suggested(spark, path).collect()} == {("s0", "x"), ("s1", "cache_key")} and "own:" in (tmp_path / "s.yml").read_text()


def test_groups_that_hold_themselves(spark):
    members = spark.createDataFrame([("a", "@b"), ("b", "@a"), ("b", "x"), ("a", "@a")], "group_name string, member string")
    assert [r.name for r in taxonomy.expand(members, spark.createDataFrame([("@a",)], "token string")).collect()] == ["x"]


def test_taxonomy(spark, tmp_path):
    (tmp_path / "t.yaml").write_text("sqli:\n  aliases: [sql-injection]\n  cwes: [CWE-89]\n  group: injection\n  validation_hints: [h1]\nxss:\n  cwes: [CWE-79]\n  group: injection\ngroups:\n  injection: [sqli, xss]\n  all: ['@injection']\n")
    classes, members = taxonomy.read_yaml(spark, str(tmp_path / "t.yaml"))
    tokens = lambda *t: spark.createDataFrame([(x,) for x in t], "token string")
    assert [r.name for r in taxonomy.resolve(classes, members, tokens("@all")).collect()] == ["sqli", "xss"]
    assert [r.name for r in taxonomy.resolve(classes, members, tokens("sql-injection")).collect()] == ["sqli"]
    assert [(r.name, r.distance) for r in taxonomy.suggest(classes, tokens("sqlli")).collect()] == [("sqli", 1)]
    assert {r.cwe for r in taxonomy.hints_by_cwe(classes).collect()} == {"CWE-89"}


def test_read_only_surface(spark):
    s = Surface(spark, {"flows": flow(spark, ("F1", "C", "codeql", "inferred", TWO))})
    assert s.sql("SELECT count(*) AS n FROM flows").first().n == 1
    assert s.sql("SELECT * FROM v_sources_to_sinks").count() == 0
    assert s.sql("WITH a AS (SELECT sid FROM flows) SELECT f.fid, (SELECT max(sid) FROM a) AS m FROM flows f WHERE EXISTS (SELECT 1 FROM a) ORDER BY fid LIMIT 3").count() == 1
    assert s.sql("SELECT fid FROM flows LATERAL VIEW explode(steps) t AS s UNION SELECT sid FROM (VALUES ('x')) v(sid)").count() == 2
    assert s.sql("SELECT * FROM v_sources_to_sinks").columns == ["source_symbol_id", "sink_symbol_id", "fids", "cwes"]
    assert s.sql("SELECT * FROM v_sinks_from_sources").columns == ["sink_symbol_id", "source_symbol_id", "fids", "cwes"]
    refused = (
        "EXECUTE IMMEDIATE 'CREATE TABLE t (a int)'", "BEGIN CREATE TABLE t (a int); END", "CREATE TEMP VIEW v USING csv OPTIONS (path '/etc/hostname')", "DECLARE VARIABLE v INT",
        "SELECT * FROM csv.`/etc/hostname`", "SELECT reflect('java.lang.System', 'exit', '1')", "SELECT (SELECT count(*) FROM text.`/etc/hostname`) FROM flows", "ADD JAR x", "SHOW TABLES", "CACHE TABLE flows",
        "WITH a AS (SELECT * FROM parquet.`/x`) SELECT * FROM a", "CALL x()", "MERGE INTO flows USING flows f ON true WHEN MATCHED THEN DELETE", "TRUNCATE TABLE flows", "EXPLAIN SELECT 1",
    )
    for bad in (*refused, "DROP TABLE flows", "INSERT INTO flows SELECT * FROM flows", "CREATE TEMP VIEW x AS SELECT 1", "SET x = 1", "DELETE FROM flows", "CREATE TABLE t AS SELECT 1"):
        with pytest.raises(ReadOnlyError):
            s.sql(bad)


def test_views_group_by_symbols(spark):
    """Two flows between the same symbols are one row, whatever their sources and sinks; flows without a symbol are a group."""
    f = flow(spark, ("F2", "C", "codeql", "inferred", TWO), ("F1", None, "joern", "inferred", TWO)).withColumn("tid", F.when(F.col("fid") == "F1", "T1").otherwise("T2"))
    f = f.withColumn("sid", F.lit("K"))
    sources = spark.createDataFrame([("T1", "S1", "c", "k", "a:1"), ("T2", "S1", "d", "k", "a:2")], schemas.TABLES["taint_sources"])
    sinks = spark.createDataFrame([("K", None, "sql.exec", "pg", "", [])], schemas.TABLES["taint_sinks"])
    s = Surface(spark, {"flows": f, "taint_sources": sources, "taint_sinks": sinks})
    assert [tuple(r) for r in s.sql("SELECT * FROM v_sources_to_sinks").collect()] == [("S1", None, ["F1", "F2"], [None, "C"])]
    assert [tuple(r) for r in s.sql("SELECT * FROM v_sinks_from_sources").collect()] == [(None, "S1", ["F1", "F2"], [None, "C"])]


def test_phases():
    assert reports.select_phases(first="analyze", last="validate") == ["analyze", "gate-2", "validate"]
    assert reports.select_phases("report,prep") == ["prep", "report"]
    for bad in ({"names": "x"}, {"first": "x"}, {"first": "report", "last": "prep"}):
        with pytest.raises(ValueError):
            reports.select_phases(**bad)


def test_reports(spark):
    f = spark.createDataFrame([("F1", "CWE-89", "T", "in src/a.b/c.ts:4", "2026-01-02"), ("F2", None, "see d.py", "none", "2026-01-02"), ("F3", "CWE-5", "t", None, "2026-01-02")], "finding_id string, cwe string, title string, body string, day string").withColumn("day", F.col("day").cast("date"))
    got = {r.finding_id: r.report for r in reports.report_metadata(f).collect()}
    assert got == {"F1": "2026-01-02--critical--sqli--c.md", "F2": "2026-01-02--informational--unknown--d.md", "F3": "2026-01-02--informational--unknown--unknown.md"}
    assert "# T" in reports.rendered(f).where("finding_id = 'F1'").first().markdown


def test_notes(spark):
    n = spark.createDataFrame([("1", "S", "a", "me", "x", False, "2026-01-01"), ("2", "S", "a", "me", "y", False, "2026-01-02"), ("3", "Z", "a", "me", "z", False, "2026-01-03")], "id string, symbol_id string, layer string, author string, content string, pinned boolean, ts string").withColumn("ts", F.col("ts").cast("timestamp"))
    assert [r.content for r in findings.visible_notes(n, "S").collect()] == ["y", "x"]
    assert [r.content for r in findings.visible_notes(n, "S", spark.createDataFrame([("2",)], "id string")).collect()] == ["x"]


def test_ids_keep_the_place_of_nulls(spark):
    import hashlib

    got = spark.range(1).select(ids.stable_id("x", F.lit("a"), F.lit(None), F.lit("b")).alias("i")).first().i
    assert got == "x:" + hashlib.sha1(b"a||b").hexdigest()[:16]


def test_streams(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    row = lambda n: json.dumps({"fid": f"F{n % 3}", "source_file": "a", "source_line": n, "sink_file": "b", "sink_line": 1, "source_name": "s", "sink_name": "k", "cwe": "C", "sink_class": "x"})
    (src / "1.jsonl").write_text("\n".join([row(1), "bad", row(2)]))
    run = lambda: streams.upsert_into(streams.graph_flows(spark, str(src), "/r"), str(tmp_path / "out"), ["fid"], ["tid"], str(tmp_path / "cp"), 4).awaitTermination()
    run()
    (src / "2.jsonl").write_text(row(4))
    run()
    got = streams.latest(spark, str(tmp_path / "out"), streams.graph_flows(spark, str(src), "/r").schema).collect()
    assert {r.fid for r in got} == {"F1", "F2"} and len(got) == 2
    assert len(list((tmp_path / "out/in_batch=1").glob("in_bucket=*"))) == 1


def test_late_rows_do_not_win(spark, tmp_path):
    """The last by event time stays, however rows are dealt to batches; only touched buckets get a new version."""
    src, out = tmp_path / "in", str(tmp_path / "out")
    src.mkdir()
    ddl = "k string, t timestamp, v int"
    for i, rows in enumerate(([("a", 5, 1), ("b", 5, 1)], [("a", 3, 2), ("a", 4, 3)], [("b", 6, 4), ("c", 1, 5)])):
        (src / f"{i}.jsonl").write_text("\n".join(json.dumps({"k": k, "t": f"2026-01-0{t} 00:00:00", "v": v}) for k, t, v in rows))
        streams.upsert_into(spark.readStream.schema(ddl).json(str(src)), out, ["k"], ["t", "v"], str(tmp_path / "cp"), 8).awaitTermination()
    schema = spark.createDataFrame([], ddl).schema
    assert {(r.k, r.v) for r in streams.latest(spark, out, schema).collect()} == {("a", 1), ("b", 4), ("c", 5)}
    assert {(r.k, r.v) for r in streams.latest(spark, out, schema, 1).collect()} == {("a", 1), ("b", 1)}


def test_watermarks_drop_late_rows(spark, tmp_path):
    """On a stream, windows close behind the watermark: a row that comes later than it is left out."""
    src, out = tmp_path / "in", tmp_path / "out"
    src.mkdir()
    files = [["2026-01-01 00:01:00", "2026-01-01 00:02:00"], ["2026-01-01 03:00:00"], ["2026-01-01 00:03:00", "2026-01-01 06:00:00"], ["2026-01-01 09:00:00"]]
    for i, times in enumerate(files):
        (src / f"{i}.jsonl").write_text("\n".join(json.dumps({"t": t, "k": "a"}) for t in times))
        stream = streams.windowed_counts(spark.readStream.schema("t timestamp, k string").json(str(src)), "t", ["k"])
        stream.writeStream.outputMode("append").format("parquet").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start(str(out)).awaitTermination()
    got = {(str(r.start), r.n) for r in spark.read.parquet(str(out)).collect()}
    assert ("2026-01-01 00:00:00", 2) in got and ("2026-01-01 03:00:00", 1) in got


def test_stream_windows(spark):
    events = spark.createDataFrame([("2026-01-01 00:01:00", "a"), ("2026-01-01 00:09:00", "a"), ("2026-01-01 00:50:00", "a")], "t string, k string").withColumn("t", F.col("t").cast("timestamp"))
    assert sorted(r.n for r in streams.windowed_counts(events, "t", ["k"]).collect()) == [1, 2]
    assert sorted(r.n for r in streams.sessions(events, "t", ["k"]).collect()) == [1, 2]
    assert streams.windowed_counts(events, "t", ["k"], "10 minutes", "5 minutes").count() > 2
