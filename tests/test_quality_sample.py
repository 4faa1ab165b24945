"""Quality samples against a plain version."""

from collections import defaultdict

from corpuslens.operators import sampling
from corpuslens.sources.corpus import from_table


def plain(rows):
    """Paths of each repository that a walk in order of extension, folder and path picks."""
    chosen = set()
    for repo in {r for r, _, _ in rows}:
        n = sum(r == repo for r, _, _ in rows)
        quota = min(10, n) if n < 50 else 15 if n < 500 else 20
        by_ext = defaultdict(list)
        for r, path, content in rows:
            ext = "." + path.rsplit(".", 1)[-1].lower()
            if r == repo and content is not None and len(content) < 100_000 and ext in sampling.r.CODE_EXTENSIONS:
                by_ext[ext].append((path.rpartition("/")[0], path))
        everything = sum(map(len, by_ext.values())) <= quota
        picked = []
        for ext in sorted(by_ext):
            own = sorted(by_ext[ext])
            take = min(max(1, quota // len(by_ext)), len(own))
            step = max(1, len(own) // take)
            picked += [p for at, (_, p) in enumerate(own) if everything or at == 0 or take == 2 and at == len(own) - 1 or take > 2 and at % step == 0]
        chosen |= {(repo, p) for p in picked[:quota]}
    return chosen


def test_files_are_numbered_in_ranges(spark):
    rows = [("big", f"d{i % 37}/e{i % 5}/f{i}.{('py', 'js', 'PY', 'md')[i % 4]}", None if i % 11 == 0 else "x" * (i % 3)) for i in range(700)]
    rows += [("small", f"{'a/' * (i % 3)}g{i}.py", "y") for i in range(7)] + [("long", "h.py", "z" * 100_000), ("long", "k/h.go", "z")]
    rows += [("middle", f"s{i % 9}/t{i}.{('ts', 'java')[i % 2]}", "c") for i in range(90)]
    files = from_table(spark.createDataFrame(rows, "repo_id string, path string, content string").repartition(5))
    picked = sampling.quality_files(files)
    assert sorted((r.repo_id, r.path) for r in picked.collect()) == sorted(plain([(r.repo_id, r.path, r.content) for r in files.collect()]))
    assert "folder" not in picked._jdf.queryExecution().optimizedPlan().toString()  # no join with a table of all folders
