from datetime import datetime


from sparklode.operators.search import broad_scope, search
from sparklode.plans.compile import Options

NAMES = ("Docs/2025/report_summary.pdf", "Docs/2024/report_draft.pdf", "Docs/2024/summary_only.pdf", "Library/Application Support/openfile.conf", "src/Tool/Engine/SearchQuery.swift")


def test_ranking_order(files, names):
    t = files("myreport.txt", "draft_report.pdf", "reports_2024.txt", "report.pdf", "report")
    assert names(t, "report") == ["report", "report.pdf", "reports_2024.txt", "draft_report.pdf", "myreport.txt"]


def test_filters(files, names):
    t = files("report.pdf", "report.txt", "draft_report.pdf", ("Archive", {"is_dir": True, "size": 0}), "Archive/archive_report.pdf", ("large.bin", {"size": 256}))
    assert names(t, "report ext:pdf !draft") == ["report.pdf", "archive_report.pdf"]
    assert set(names(t, "path:Archive")) == {"Archive", "archive_report.pdf"}
    assert names(t, "size:>100b") == ["large.bin"] and names(t, "folder:Archive") == ["Archive"]
    assert "Archive" in names(t, "NOT size:>1k")


def test_macros_and_globs(files, names):
    t = files("briefing.pdf", "briefing.txt", "travel.jpg", "travel.png", "travel.gif", "tool.swift", "invoice.docx", ("empty.txt", {"size": 0}), ("tiny.txt", {"size": 1}), "*.rs", "main.rs")
    assert names(t, "*.pdf briefing") == ["briefing.pdf"]
    assert set(names(t, "ext:png;jpg travel")) == {"travel.jpg", "travel.png"}
    assert names(t, "type:code tool") == ["tool.swift"] and names(t, "doc:invoice") == ["invoice.docx"]
    assert names(t, "size:empty") == ["empty.txt"]
    assert "tiny.txt" in names(t, "size:!=0b") and "empty.txt" not in names(t, "size:!=0b")
    assert names(t, '"*.rs"') == ["*.rs"]


def test_paths(files, names):
    t = files(*NAMES)
    assert set(names(t, "report summary|draft ext:pdf")) == {"report_summary.pdf", "report_draft.pdf"}
    assert set(names(t, "<summary|draft> ext:pdf")) == {"report_summary.pdf", "report_draft.pdf", "summary_only.pdf"}
    assert set(names(t, "report_*.pdf")) == {"report_summary.pdf", "report_draft.pdf"}
    assert "openfile.conf" in names(t, "brary/Applicat")
    for p in ("src/**/SearchQuery.swift", "/SearchQuery.swift/"):
        assert names(t, p) == ["SearchQuery.swift"]
    u = files(("ProjectName", {"is_dir": True}), "ProjectName/unrelated.txt")
    assert names(u, "ProjectName") == ["ProjectName"] and names(u, "ProjectName/unrelated") == ["unrelated.txt"]


def test_scopes_tags_dates(files, names):
    t = files(("/Scope", {"is_dir": True}), "/Scope/direct.log", ("/Scope/Nested", {"is_dir": True}), "/Scope/Nested/nested.log", ("/Report-2026.md", {"tags": ["ProjectA\n6", "Important"], "created": datetime(2026, 1, 1), "size": 8}), ("/Report-old.md", {"size": 2}))
    assert names(t, "parent:/Scope file:") == ["direct.log"]
    assert set(names(t, "in:/Scope ext:log")) == {"direct.log", "nested.log"}
    assert set(names(t, "nosubfolders:/Scope")) == {"Scope", "direct.log"}
    assert names(t, "tag:proj") == ["Report-2026.md"]
    assert names(t, '"regex:^Report-[0-9]{4}\\\\.md$"') == ["Report-2026.md"]
    assert names(t, "dc:>=2025-01-01") == ["Report-2026.md"]


def test_content(files, names):
    t = files(("alpha.txt", {"text": "red"}), ("beta.txt", {"text": "blue"}), ("both.txt", {"text": "red\nblue"}), ("neither.txt", {"text": "green"}), ("none.txt", {"text": None}))
    assert names(t, "content:red content:blue") == ["both.txt"]
    assert set(names(t, "content:red|content:blue")) == {"alpha.txt", "beta.txt", "both.txt"}
    assert set(names(t, "!content:red ext:txt")) == {"beta.txt", "neither.txt"}
    assert set(names(t, "alpha|content:blue")) == {"alpha.txt", "beta.txt", "both.txt"}
    assert set(names(t, "r.d", Options(target="content", mode="regex"))) == {"alpha.txt", "both.txt"}
    assert search(t, "content:blue").filter("name = 'both.txt'").first()["preview"] == "blue"
    assert set(names(t, "!red", Options(target="content"))) == {"beta.txt", "neither.txt"}


def test_targets_and_visibility(files, names):
    t = files("apple_name.txt", ("banana.txt", {"text": "an apple"}), (".hidden_apple.txt", {"hidden": True, "text": "apple"}), ("T.bundle/package_apple.txt", {"in_package": True, "text": "apple"}), ("small.txt", {"text": "apple", "size": 45}), ("large.txt", {"text": "apple", "size": 195}))
    assert names(t, "apple") == ["apple_name.txt"]
    assert set(names(t, "apple", Options(target="content"))) == {"banana.txt", "small.txt", "large.txt"}
    assert "large.txt" not in names(t, "apple", Options(target="content", max_content_size=100))
    both = names(t, "apple", Options(target="both", include_hidden=True))
    assert ".hidden_apple.txt" in both and len(both) == len(set(both)) == 5


def test_modes(files, names):
    t = files("swift", "swift developer", "hello swift!", "swifty", "myswift", "a.txt", ".txt", "a.txt.bak", "abc", "abbc")
    assert set(names(t, "swift", Options(mode="word"))) == {"swift", "swift developer", "hello swift!"}
    assert set(names(t, "a?c", Options(mode="wildcard"))) == {"abc"}
    assert set(names(t, "^swift", Options(mode="regex"))) == {"swift", "swift developer", "swifty"}


def test_usage_breaks_ties_only(spark, files, names):
    t = files("/deep/report", "/deeper/report.txt", "/alpha-report.txt", "/very/deep/beta-report.txt")
    used = spark.createDataFrame([("/very/deep/beta-report.txt", 20, datetime(2024, 1, 1)), ("/deeper/report.txt", 100, datetime(2024, 1, 1))], "path string, open_count long, last_opened timestamp")
    assert names(t, "report", usage=used) == ["report", "report.txt", "beta-report.txt", "alpha-report.txt"]


def test_pinyin(files, names):
    t = files("报告.docx", "表格.xlsx", "other.txt")
    assert set(names(t, "bg")) == {"报告.docx", "表格.xlsx"}


def test_pages_and_pushdown(files, spark, tmp_path):
    t = files(*(f"f{i}.txt" for i in range(30)))
    page = search(t, "f", limit=10, offset=10).collect()
    assert sorted(r["rank"] for r in page) == list(range(11, 21))
    t.write.parquet(str(tmp_path / "f"))
    plan = search(spark.read.parquet(str(tmp_path / "f")), "f in:/root/x", limit=5)._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in plan and "StringStartsWith(path,/root/x/)" in plan and "text" not in plan.split("ReadSchema")[1].split("\n")[0]


def test_broad_scope():
    assert broad_scope(["/"]) and broad_scope(["/Users/"]) and not broad_scope(["/data/x"])
