import os
import uuid

from pyspark.sql import functions as F

from corpuslens.sources import corpus, repositories, trees


def listing_of(spark, root, folder, **settings):
    target = f"file://{folder}/{uuid.uuid4().hex}"
    repositories.write_listing(repositories.list_tree(spark, str(root), **settings), target, corpus.readable_name, bucket_bytes=200_000)
    return target


def test_a_deep_repository_is_listed_in_rounds(spark, tmp_path):
    """One repository of many nested folders, a few folders per task and round, links and excluded folders left out."""
    root, expected = tmp_path / "root", set()
    for i in range(12):
        folder = root / "one" / "/".join(f"d{j}" for j in range(i))
        folder.mkdir(parents=True, exist_ok=True)
        for name in ("a.py", ".hidden", "b.bin"):
            (folder / name).write_text(f"{i}")
            expected.add(("one", os.path.relpath(folder / name, root / "one")))
    (root / "one" / ".git").mkdir()
    (root / "one" / ".git" / "HEAD").write_text("x")
    (root / "one" / "loop").symlink_to(root / "one")
    (root / "two").mkdir()
    (root / "two" / "loose.py").write_text("no repository")
    for n in (1, 3, 100):
        got = repositories.list_tree(spark, str(root), folders_per_start=n)
        assert {(r.repo_id, r.path) for r in got.collect()} == expected and got.count() == len(expected)


def test_filters_reach_the_reader_and_decide_what_is_opened(spark, tmp_path):
    root = tmp_path / "root"
    (root / "r" / ".git").mkdir(parents=True)
    for i in range(20):
        (root / "r" / f"m{i}.py").write_text("x" * i)
    (root / "r" / "big.py").write_text("y" * 1000)
    listing = listing_of(spark, root, tmp_path)
    source = repositories.open_listing(spark, listing)
    assert source.rdd.getNumPartitions() > 3  # buckets, each a task
    for n in (18, 19):
        os.remove(root / "r" / f"m{n}.py")  # opening one of these would be an error
    small = source.where((F.col("size") < 18) & F.endswith("name", F.lit(".py")) & F.startswith("path", F.lit("m")))
    rows = small.collect()
    assert sorted(len(r.content) for r in rows) == list(range(18)) and all(r.error is None for r in rows)
    reader = repositories.RepositoryReader(listing)
    from pyspark.sql import datasource as ds

    held = list(reader.pushFilters([ds.LessThan(("size",), 18), ds.IsNotNull(("size",)), ds.EqualTo(("content",), "x"), ds.IsNull(("error",))]))
    assert [type(f).__name__ for f in held] == ["EqualTo", "IsNull"] and reader.pushed == [("LessThan", "size", 18)]
    assert [(r.path, r.content, r.error is None) for r in source.where("name in ('m18.py', 'm3.py')").orderBy("size").collect()] == [("m3.py", "xxx", True), ("m18.py", None, False)]


def test_errors_are_a_column_on_request(spark, tmp_path):
    root = tmp_path / "root"
    (root / "r" / ".git").mkdir(parents=True)
    (root / "r" / "a.py").write_text("x = 1")
    (root / "r" / "nowhere.py").symlink_to(root / "nowhere")  # no file
    got = [tuple(r) for r in corpus.load_corpus(spark, str(root), errors=True).select("path", "content", "error").collect()]
    assert got == [("a.py", "x = 1", None)]
    assert corpus.load_corpus(spark, str(root)).columns == ["repo_id", "path", "size", "content"]
    gone = repositories._text_of(repositories._client(str(root)), str(root / "r" / "nowhere.py"))
    assert gone[0] is None and gone[1]


def test_empty_roots_and_all_extensions(spark, tmp_path):
    assert corpus.load_corpus(spark, str(tmp_path)).collect() == []
    (tmp_path / "main.tf").write_text("resource")
    (tmp_path / "x.png").write_text("binary")
    (tmp_path / "Dockerfile").write_text("FROM x")
    content = lambda **s: {r.path: r.content for r in corpus.load_corpus(spark, str(tmp_path), **s).collect()}
    assert content() == {"main.tf": None, "x.png": None, "Dockerfile": "FROM x"}
    assert content(extensions=corpus.ALL) == {"main.tf": "resource", "x.png": None, "Dockerfile": "FROM x"}
    assert content(extensions=[]) == content() and content(max_file_bytes=3)["Dockerfile"] is None


def test_trees_of_portions_hold_few_files_at_once_and_lose_none(spark, tmp_path):
    """A portion is read and removed before the next is written; a large repository lies in several."""
    rows = [("big" if i < 50 else f"r{i % 7}", f"d{i}/m{i}.py", f"x = {i}\n") for i in range(90)]
    files, seen = spark.createDataFrame(rows, "repo_id string, path string, content string"), []

    def read(target):
        location = target.removeprefix("file:")
        seen.append(sum(len(names) for _, _, names in os.walk(location)))
        return corpus.load_corpus(spark, target).select("repo_id", "path", "content")

    got = trees.through_trees(files, read, files_at_once=20).collect()
    assert sorted(map(tuple, got)) == sorted(rows) and seen == [20, 20, 20, 20, 10]
    assert trees.through_trees(files.where("false"), read).count() == 0


def test_equal_texts_of_a_tree_lie_on_disk_once_and_part_when_it_is_written_again(spark, tmp_path):
    rows = [("r", f"d{i}/m{i}.py", f"x = {i % 2}\n") for i in range(100)]
    files = lambda rows: spark.createDataFrame(rows, "repo_id string, path string, content string").coalesce(1)
    target = str(tmp_path / "tree")
    texts = lambda: sorted(tuple(r) for r in corpus.load_corpus(spark, target).select("repo_id", "path", "content").collect())
    taken = trees.write_tree(files(rows), target, share_texts=True)
    assert texts() == sorted(rows) and taken == (2 + 101) * trees.BLOCK
    assert len({os.stat(tmp_path / "tree" / "r" / p).st_ino for _, p, _ in rows}) == 2
    changed = [(r, p, "y = 1\n" if p == "d7/m7.py" else c) for r, p, c in rows]
    for again in (changed[7:8], rows, changed):  # a name alone, then all
        trees.write_tree(files(again), target, share_texts=len(again) > 1)
        assert texts() == sorted(rows if again is rows else changed)


def test_trees_stay_until_they_take_too_much_disk(spark, tmp_path, monkeypatch):
    rows = [(f"r{i % 3}", f"m{i}.py", f"x = {i}\n") for i in range(50)]
    files, removed, remove = spark.createDataFrame(rows, "repo_id string, path string, content string"), [], trees.remove_tree

    def noted(repositories, target):
        removed.append(int(target.rsplit("-", 1)[1]))
        remove(repositories, target)
        assert not os.path.exists(target.removeprefix("file:"))

    monkeypatch.setattr(trees, "remove_tree", noted)
    read = lambda target: corpus.load_corpus(spark, target).select("repo_id", "path", "content")
    for bytes_kept, gone in ((1 << 30, []), (0, [0, 1, 2, 3])):
        removed.clear()
        got = trees.through_trees(files, read, files_at_once=10, bytes_kept=bytes_kept).collect()
        assert sorted(map(tuple, got)) == sorted(rows) and removed == gone
