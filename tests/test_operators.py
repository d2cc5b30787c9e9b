"""Operators on small inputs, against plain Python or by hand."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from cairn.functions import manifests, urls
from cairn.operators import chunking, commits, folds, gate, joins, profile, store
from cairn.plans.components import components
from cairn.sources import files, history
from cairn.sources.snapshots import SnapshotTable


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_latest_keeps_last_and_first(spark):
    df = spark.createDataFrame([(1, "a", 1), (1, "b", 3), (1, "c", 2), (2, None, 1)], "k int, v string, at int").withColumn("seen", F.col("at"))
    assert rows(store.latest(df, ["k"], "at", first={"seen": "at"}).fillna("-")) == [(1, "b", 3, 1), (2, "-", 1, 1)]
    assert rows(store.latest(df.limit(0), ["k"], "at")) == []


def test_insert_replace_delete(spark):
    old = spark.createDataFrame([("x", 1), ("y", 2)], "k string, n int")
    new = spark.createDataFrame([("y", 5), ("z", 7), ("z", 6)], "k string, n int")
    assert rows(store.insert_new(old, new, "k", "n")) == [("x", 1), ("y", 2), ("z", 6)]
    assert rows(store.replace_by_key(old, new, "k")) == [("x", 1), ("y", 5), ("z", 6), ("z", 7)]
    assert rows(store.delete_by_key(old, new, "k")) == [("x", 1)]


def test_components(spark):
    links = spark.createDataFrame([(1, 2), (2, 3), (10, 9), (9, 8), (8, 7), (20, 20), (None, 4)], "a bigint, b bigint")
    assert rows(components(links)) == [(1, 1), (2, 1), (3, 1), (7, 7), (8, 7), (9, 7), (10, 7), (20, 20)]
    assert rows(components(links.limit(0))) == []
    chain = spark.range(200).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    assert {r.component for r in components(chain).collect()} == {0}


def test_as_of_joins(spark):
    t = lambda m: dt.datetime(2024, 1, 1, 0, 0) + dt.timedelta(minutes=m)
    left = spark.createDataFrame([(1, 7, t(0)), (2, 7, t(100)), (3, 8, t(0))], "id int, u int, at timestamp_ntz")
    right = spark.createDataFrame([(7, t(5), 50), (7, t(3), 51), (7, t(2000), 52)], "u int, r_at timestamp_ntz, r_id int")
    assert [(r.id, r.r_id) for r in joins.first_within(left, right, ["u"], "at", "r_at", 720, id_col="id", tie="r_id").collect()] == [(1, 51)]
    back = {r.id: r.r_id for r in joins.last_before(left, right, ["u"], "at", "r_at", ["r_id"]).collect()}
    assert back == {1: None, 2: 50, 3: None}
    late = spark.createDataFrame([(9, 7, t(5000))], "id int, u int, at timestamp_ntz")
    assert joins.last_before(late, right, ["u"], "at", "r_at", ["r_id"]).first().r_id == 52


def test_budget_folds(spark):
    df = spark.createDataFrame([("q", i, c) for i, c in enumerate([700, 500, 400, 300, 200, 90])], "q string, i int, cost int")
    kept = folds.fit_budget(df, ["q"], [F.col("i")], "cost", 1500)
    assert [(r.i, r.used) for r in kept.orderBy("i").collect()] == [(0, 700), (1, 1200), (3, 1500)]
    assert [r.i for r in folds.fit_budget(df, ["q"], [F.col("i")], "cost", 1500, stop=True).orderBy("i").collect()] == [0, 1]
    assert [r.i for r in folds.fit_budget(df, ["q"], [F.col("i")], "cost", 5000, most=2).orderBy("i").collect()] == [0, 1]


def test_host_policy(spark):
    u = ["https://docs.fen.example/a/b/?q=1", "https://login.fen.example/x", "http://192.168.0.2/y", "https://sub.bad.example/z", "ftp://fen.example/a", "not a url", "https://fen.example/r/https:%2F%2Fother.example", "http://intranet/x"]
    pages = spark.createDataFrame([(x,) for x in u], "url string")
    denied = spark.createDataFrame([("Bad.example",)], "domain string")
    got = urls.allowed(pages, "url", denied, "domain").select(urls.clean_url(F.col("url"))).collect()
    assert [r[0] for r in got] == ["https://docs.fen.example/a/b"]


def test_commit_messages(spark):
    m = "feat(api)!: move the reader to arrow batches\n\nWe did this because rows were slow. Used arrow instead of pickle, rather than pickle.\nSigned-off-by: A"
    c = F.col("m")
    r = spark.createDataFrame([(m,)], "m string").select(commits.conventional(c).alias("c"), commits.stated_reason(c).alias("why"), commits.rejected(c).alias("no"), commits.body(c).alias("body")).first()
    assert tuple(r.c) == ("feat", "api", "move the reader to arrow batches")
    assert r.why.startswith("We did this because") and r.no == ["pickle"] and "Signed-off" not in r.body
    v = spark.createDataFrame([('Revert "add cache"',), ("Merge branch 'origin/fast'",)], "m string").select(commits.reverted(c), commits.merged_branch(c)).collect()
    assert [tuple(x) for x in v] == [("add cache", None), (None, "fast")]


@pytest.mark.parametrize("prompt, task", [("why does training crash with an error?", "debug"), ("should I use sqlite or postgres for this?", "architect"), ("how did I set up the eval harness before?", "explore"), ("clean up this module", "refactor"), ("add a retry", "implement"), ("hello there", "implement")])
def test_task_types(spark, prompt, task):
    assert spark.createDataFrame([(prompt,)], "p string").select(gate.task_type("p")).first()[0] == task


def test_trivial_prompts(spark):
    df = spark.createDataFrame([("rename this variable",), ("what does this do",), ("swap these",), ("why is recall low",), ("  ",)], "p string")
    got = [r[0] for r in df.select(gate.trivial_reason(F.col("p"), F.lit(False))).collect()]
    assert got == ["mechanical edit", "asks about code already on screen", "short local edit naming nothing memory holds", None, "empty prompt"]


def test_chunkers():
    text = "# A\n" + "x " * 40 + "\n\n```\n# not a heading\n```\n\n## B\n" + "\n\n".join("line %d " % i + "word " * 60 for i in range(12))
    got = chunking.markdown(text)
    lines = text.splitlines()
    assert {p[1] for p in got} == {"A", "A > B"} and all(len(p[0]) <= 1800 for p in got)
    assert all("\n".join(lines[p[2] - 1 : p[3]]) == p[0] for p in got)
    assert chunking.notebook("nope") == [] == chunking.results_json("nope") == chunking.plain("") == chunking.run_log("") == chunking.markdown("")


def test_windows_never_cut_a_line():
    small, large = "w" * 800, "\n".join("v" * 700 for _ in range(4))
    got = chunking.plain("\n\n".join([small, small, large, small, "u" * 5000, "end"]))
    # 801 + 1 + 801 characters fit; a paragraph above the size stands alone, in lines; a longer line stays whole.
    assert [(len(p[0]), p[2], p[3]) for p in got] == [(1602, 1, 3), (1401, 5, 6), (1401, 7, 8), (800, 10, 10), (5000, 12, 12), (3, 14, 14)]
    assert [len(p[0]) for p in chunking.plain("a" * 899 + "\n\n" + "b" * 898)] == [1799] and len(chunking.plain("a" * 900 + "\n\n" + "b" * 899)) == 2


def test_short_sections_go_with_the_next():
    got = chunking.markdown("intro\n# One\n" + "c" * 54 + "\n# Two\n" + "d" * 80)
    assert [(p[1], p[2], p[3]) for p in got] == [("One", 1, 3), ("Two", 4, 5)]  # 5 + 5 + 54 characters, line ends not counted
    assert [(p[1], p[2]) for p in chunking.markdown("# One\nshort\n# Two ##\nshort too")] == [("Two", 1)]


def test_source_notebook_and_results():
    source = '# Licence\n# and purpose\n\n"""Top\nline."""\nimport x\n\ndef f():\n    """Does it."""\n    return 1\n\nclass C:\n    def g(self):\n        """Not at the top."""\n'
    assert [(p[1], p[2], p[3]) for p in chunking.python_source(source)] == [("module", 1, 5), ("f", 8, 9)]
    assert chunking.python_source(source)[1][0] == 'def f():\n    """Does it."""'
    assert chunking.python_source("def (:\nx")[0][:4] == ("def (:\nx", "", 1, 2) and chunking.python_source("x = 1") == []
    cells = [
        {"cell_type": "markdown", "source": ["# Title\n", "a text of some length"]}, {"cell_type": "markdown", "source": "too short"},
        {"cell_type": "code", "source": "x = 1", "outputs": [{"output_type": "stream", "text": ["1", "2"]}, {"output_type": "display_data", "data": {"image/png": "no", "text/plain": "fig"}}]}, {"cell_type": "code", "source": "y = 2", "outputs": []},
    ]
    got = chunking.notebook(json.dumps({"cells": cells}))
    assert [(p[1], p[4]) for p in got] == [("Title", "cell 1"), ("Title", "cell 3")] and got[1][0] == "```python\nx = 1\n```\n\nOutput:\n12\nfig"
    data = {"a": {"b": 1, "note": "s" * 121, "none": None}, "c": [1, 2.5], "d": list(range(9)), "e": [{"f": "x"}] * 6, "g": True}
    assert chunking.results_json(json.dumps(data)) == [("a.b: 1\nc: [1, 2.5]\nd: [0, 1, 2, 3, 4, 5, 6, 7, ...]\n" + "\n".join(f"e[{i}].f: x" for i in range(5)) + "\ng: True", "results", 0, 0, "json")]
    assert chunking.results_json('{"a": "no number"}') == []
    log = "start\n\nepoch 1 loss 0.5\nx\ny\nepoch 2 loss 0.4\n\n" + "z\n" * 5 + "val acc: 0.9"
    assert [(p[2], p[3]) for p in chunking.run_log(log)] == [(3, 6), (12, 13)]


def test_manifests(spark):
    df = spark.createDataFrame(
        [("package.json", '{"dependencies": {"Next": "1"}, "devDependencies": {"vue": "2"}}'), ("requirements-dev.txt", "# c\ntorch>=2\n-r x\nnumpy[all]==1"), ("go.mod", "require (\n\tgithub.com/a/b v1.2\n)"), ("pyproject.toml", '[project]\ndependencies = ["fastapi>=1"]'), ("Cargo.toml", "not toml ["), ("notes.md", "x"), ("environment.yml", "name: x\ndependencies:\n  - numpy=1\n  - pip\n"), (None, None)],
        "name string, body string",
    ).select("name", manifests.manifest("name", "body").alias("m"))
    got = {r.name: (r.m.language, r.m.dependencies) for r in df.collect()}
    assert got["package.json"] == ("javascript", ["next", "vue"]) and got["requirements-dev.txt"] == ("python", ["numpy", "torch"])
    assert got["go.mod"] == ("go", ["github.com/a/b"]) and got["pyproject.toml"] == ("python", ["fastapi"]) and got["Cargo.toml"] == ("rust", [])
    assert got["notes.md"] == (None, None) and got["environment.yml"][1] == ["numpy", "pip"]


def test_profile_life(spark):
    t = lambda d: dt.datetime(2025, 1, d)
    s = spark.createDataFrame([(1, "Prefers small plain modules everywhere", "proposed", 0.9, t(1)), (2, "Avoids global state in tests", "proposed", 0.5, t(1)), (3, "Uses one formatter for all", "dormant", 0.9, t(1))], "statement_id int, statement string, status string, confidence double, last_confirmed_at timestamp_ntz")
    e = spark.createDataFrame([(1, "activate", t(2)), (1, "supersede", t(3)), (1, "activate", t(4)), (2, "activate", t(2)), (3, "confirm", t(5))], "statement_id int, event string, at timestamp_ntz")
    got = {r.statement_id: (r.status, r.last_confirmed_at.day) for r in profile.replay(s, e).collect()}
    assert got == {1: ("superseded", 2), 2: ("proposed", 1), 3: ("active", 5)}
    fresh = spark.createDataFrame([("  prefers SMALL plain modules everywhere",), ("Writes tests before the code",), ("Too short",)], "statement string")
    assert [r.statement for r in profile.seed(s, fresh).collect()] == ["Writes tests before the code"]


def test_snapshots_and_capture(spark, tmp_path):
    from cairn.streaming.capture import upsert_pages

    target = SnapshotTable(spark, f"file://{tmp_path}/pages")
    assert target.read() is None
    merge = upsert_pages(target)
    page = lambda u, x, d: (u, x * 100, dt.datetime(2025, 1, d))
    schema = "uri string, text string, captured_at timestamp_ntz"
    merge(spark.createDataFrame([page("a", "x", 1), page("a", "y", 2), ("s", "short", dt.datetime(2025, 1, 1))], schema), 0)
    merge(spark.createDataFrame([page("a", "y", 3), page("b", "z", 3)], schema), 1)
    merge(spark.createDataFrame([page("c", "z", 3)], schema), 1)
    assert sorted((r.uri, r.text[0], r.captured_at.day) for r in target.read().collect()) == [("a", "y", 2), ("b", "z", 3)]
    assert [v for v, _ in target.versions()] == [1, 2]
    target.prune(1)
    assert [v for v, _ in target.versions()] == [2]


def test_file_walk(spark, tmp_path):
    for name, body in {"a/note.md": "hello", "a/.env": "X=1", "node_modules/x.md": "no", "a/results/r.json": "{}", "a/r.json": "{}", "b/passport.md": "x", "b/keep.py": "x", "b/skip.py": "x", "b/empty.md": "", "b/run.log": "tail\n"}.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(body)
    for i in range(4):
        (tmp_path / "flood").mkdir(exist_ok=True)
        (tmp_path / f"flood/{i}.txt").write_text("x")
    got = files.walk(spark, str(tmp_path), ignore=["skip.*"], flood=3)
    assert sorted(r.path for r in got.collect()) == ["a/note.md", "a/results/r.json", "b/keep.py", "b/run.log"]
    assert {r.path: r.text for r in files.read_text(spark, got, str(tmp_path)).collect()}["a/note.md"] == "hello"


def test_histories(spark, tmp_path):
    log = tmp_path / "log.txt"
    log.write_text("\x1f".join(["aa", "", "Ann", "Ann@X.example", "2025-01-02T03:04:05+00:00", "tag: v1", "feat: x", "why"]) + "\x1e\n" + "\x1f".join(["bb", "aa cc", "Bo", "bo@x.example", "2025-02-02T03:04:05+00:00", "", "merge", ""]) + "\x1e\n")
    got = history.commits(spark, str(log), spark.createDataFrame([("ann@x.example",)], "email string"))
    assert [(r.sha, r.parents, r.subject) for r in got.collect()] == [("aa", [], "feat: x")]
    assert history.author_histogram(history.commits(spark, str(log))).count() == 2
    micros = 11_644_473_600_000_000
    visits = spark.createDataFrame([(1, 5, micros), (2, 5, micros + 60_000_000)], "id int, url int, visit_time bigint")
    addresses = spark.createDataFrame([(5, "https://a.example/x", "T")], "id int, url string, title string")
    p = history.pages(visits, addresses).first()
    assert (p.n_visits, p.title, p.first_at.year) == (2, "T", 1970)
    (tmp_path / "s").mkdir()
    (tmp_path / "s/one.jsonl").write_text('{"type": "user", "timestamp": "2025-01-01T00:00:00Z", "message": {"role": "user", "content": "hi <system-reminder>x</system-reminder>"}}\n{"type": "assistant", "timestamp": "2025-01-01T00:00:01Z", "message": {"role": "assistant", "content": [{"type": "text", "text": "yes"}, {"type": "tool_use", "text": null}]}}\n{"type": "summary"}\n')
    assert [(r.session, r.speaker, r.text) for r in history.session_rows(spark, str(tmp_path / "s")).orderBy("at").collect()] == [("one", "user", "hi"), ("one", "assistant", "yes")]
