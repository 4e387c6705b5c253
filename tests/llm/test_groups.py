"""SimHash groups, archives, quotations and the pipeline against brute force and on odd rows."""

import gzip
import io
import itertools
import random
import re
from hashlib import sha256

import corpus_pipeline
import numpy as np
import pytest
import xxhash

from tessavox.llm import archives, quotes, simhash
from tessavox.llm.queries import OP5, OP8, QUOTED, op5_quotation_links, op8_archives, op10_simhash, quoted, quoted_conversations

# --- SimHash


def slow_fingerprint(t):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
    w = re.findall("[^\x20\x09-\x0d]+", lower)
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(" ".join(w[i : i + 3]).encode(), seed=42) for i in range(max(1, len(w) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def components(rows, radius=2):
    """rows: id and fingerprint; smallest id of each row's group, by all pairs."""
    fp = np.array([f for _, f in rows], np.uint64)
    label = np.arange(len(rows))
    while True:
        new = np.array([label[np.bitwise_count(fp ^ f) <= radius].min() for f in fp])
        if (new == label).all():
            break
        label = new
    ids = {}
    for k, (i, _) in zip(label.tolist(), rows, strict=True):
        if i is not None:
            ids[k] = min(ids.get(k, i), i)
    return sorted(((i, f"{f:016x}", ids.get(k)) for k, (i, f) in zip(label.tolist(), rows, strict=True)), key=str)


def test_fingerprints(texts, odd_rows):
    for _, t in texts[:120] + odd_rows:
        assert simhash.fingerprint(t) == slow_fingerprint(t)


def test_groups_on_the_table(spark, data, texts):
    got = op10_simhash(spark, data).collect()
    assert sorted(map(tuple, got), key=str) == components([(i, simhash.fingerprint(t)) for i, t in texts])


@pytest.mark.parametrize("seed", range(8))
def test_tree_finds_every_pair(seed):
    rng = np.random.default_rng(seed)
    fp = rng.integers(0, 1 << 63, 300, dtype=np.uint64)
    for _ in range(3):
        fp = np.unique(np.concatenate([fp, fp[: len(fp) // 2] ^ (np.uint64(1) << rng.integers(0, 64, len(fp) // 2, dtype=np.uint64))]))
    forest = simhash.Forest(len(fp))
    every = np.arange(len(fp))
    simhash.search_tree(every, every, fp, 2, forest, leaf=8)
    near = np.bitwise_count(fp[:, None] ^ fp[None]) <= 2
    label = every.copy()
    while True:
        new = np.array([label[n].min() for n in near])
        if (new == label).all():
            break
        label = new
    assert (forest.root == label).all()


def test_groups_over_many_shards(spark):
    """Chains of one-bit steps that cross shards, found whatever the shards are."""
    rng = random.Random(9)
    fps, at = [], rng.getrandbits(64)
    for _ in range(300):
        at ^= 1 << rng.randrange(64)
        fps.append(at)
    fps = list(dict.fromkeys(fps + [rng.getrandbits(64) for _ in range(300)]))
    rng.shuffle(fps)
    rows = list(enumerate(fps))
    nodes = spark.createDataFrame([(i, int(np.uint64(f).view(np.int64))) for i, f in rows], "least long, fp long")
    groups = simhash.contracted(simhash._links(nodes.select("fp", "least"), len(rows), 2, 2, 60)).collect()
    root = {r.node: r.root for r in groups}
    mine = {}
    for i, f in rows:
        s = int(np.uint64(f).view(np.int64))
        mine.setdefault(root.get(s, s), []).append(i)
    wanted = {}
    for i, _, c in components(rows):
        wanted.setdefault(c, []).append(i)
    assert sorted(map(sorted, mine.values())) == sorted(map(sorted, wanted.values()))


def test_shards_have_no_ceiling():
    """More shards than the former bound of 4,096; each fingerprint at home in one, and sent to few others."""
    assert simhash.shards_of(10) == 1 and simhash.shards_of(50_000) == 12 and simhash.shards_of(10**6) == 16 and simhash.shards_of(5 * 10**10) > 190_000
    rng = np.random.default_rng(3)
    points = rng.integers(0, 1 << 63, 320_000, dtype=np.uint64)
    tree = simhash.Node(points, 5000, itertools.count())
    home, every = np.zeros(len(points), np.int64), np.arange(len(points))
    tree.home(points, every, home)
    assert len(set(home.tolist())) > 4500
    for n, most in ((13 * 10**6, 4), (2 * 10**6, 3)):
        shards = simhash.shards_of(n)
        tree = simhash.Node(points[: simhash.SAMPLE * shards], shards, itertools.count())
        fp = rng.integers(0, 1 << 63, 100_000, dtype=np.uint64)
        home, out, every = np.zeros(len(fp), np.int64), [], np.arange(len(fp))
        tree.home(fp, every, home)
        tree.reached(fp, every, 2, out)
        rows = sum(int((home[at] <= k).sum()) for k, at in out)
        assert rows / len(fp) < most, rows / len(fp)


def test_groups_of_odd_rows(spark, odd, odd_rows, none):
    got = simhash.near_duplicates(odd).drop("row_key").collect()
    assert sorted(map(tuple, got), key=str) == components([(i, simhash.fingerprint(t)) for i, t in odd_rows])
    assert simhash.near_duplicates(none).count() == 0 and simhash.deduplicated(none).count() == 0
    left = simhash.deduplicated(odd)
    ids = [r[left.columns.index("doc_id")] for r in left.collect()]
    assert left.columns == odd.columns and ids.count(5) == 1 and ids.count(None) == 2
    assert len(set(ids) - {None}) == len([i for i in ids if i is not None])
    assert [r[left.columns.index("text")] for r in left.collect() if r[left.columns.index("doc_id")] == 6] == ["another text under a known id"]


# --- archives


def test_archives_against_sql(spark, data, duck, rows_of):
    assert rows_of(op8_archives(spark, data).toArrow()) == rows_of(duck.sql(OP8).to_arrow_table())


@pytest.mark.parametrize("version", ["1", "2"])
def test_archives_of_odd_pages(spark, version):
    page = "<p>é😀" + "x" * 200 + "</p>\r\n\r\nWARC/1.1\r\n\n\nhttp://a 0.0.0.0 1 text/html 5\n"
    rows = [(5, "http://a b\n", page), (3, None, page), (9, "", None), (8, "u", ""), (7, "u", "small"), (6, "u", "small"), (None, "u", page), (3, "v", page), (11, "u", "y" * 100), (10, "w", "y" * 100), (12, "u", "HTTP/1.1 fake\r\n\r\nbody" * 20)]
    pages = spark.createDataFrame([("?", *r, "?", "?") for r in rows], "digest string, page_id long, url string, html string, payload string, first string")
    got = sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in archives.archived(pages, version).collect()), key=str)
    raw = [(i, (h or "").encode()) for i, _, h in rows]
    least = {}
    for i, h in raw:
        if i is not None:
            least[h] = min(least.get(h, i), i)
    again = lambda i, h: i is not None and len(h) >= 100 and i != least[h]
    wanted = sorted(((i, len(h), sha256(h).hexdigest(), "revisit" if again(i, h) else "response", least[h] if again(i, h) else None) for i, h in raw), key=str)
    assert got == wanted
    whole = [r for r in archives.archived(pages, version).collect() if r.record_type == "response"]
    assert sorted(bytes(r.payload) for r in whole) == sorted(h for i, h in raw if not again(i, h))
    assert archives.archived(pages.limit(0)).count() == 0


def test_files_are_bounded_by_bytes(spark, tmp_path, monkeypatch):
    """Large pages get files of their own, whatever their number; what is stored is the same."""
    monkeypatch.setattr(archives, "FILE_BYTES", 1 << 20)
    monkeypatch.setattr(archives, "SMALL_RECORD", 4 << 10)
    rng = np.random.default_rng(2)
    sizes = [int(x) for x in rng.choice([0, 10, 4000, 5000, 60_000, 300_000, 1_200_000], 300)]
    pages = spark.createDataFrame([(i, "u", f"{i}" + "x" * n) for i, n in enumerate(sizes)], "page_id long, url string, html string").coalesce(1)
    archives.write_arc(pages, str(tmp_path / "arc"))
    files = [f for f in (tmp_path / "arc").rglob("part-*") if not f.name.endswith(".crc")]
    lengths = [[len(c) for _, c in archives.arc_records(gzip.open(f))] for f in files]
    assert sum(map(len, lengths)) == 300 and all(sum(x) < 1.2 * (1 << 20) or len(x) == 1 for x in lengths)
    assert sorted(r.payload_bytes for r in archives.archived(pages).collect()) == sorted(n + len(str(i)) for i, n in enumerate(sizes))


def test_foreign_archive_lines():
    body = b"HTTP/1.0 200 OK\nnot split\n"
    v1 = b"filedesc://x.arc 0 19960923142103 text/plain 76\n1 0 Org\nURL IP-address Archive-date Content-type Archive-length\n"
    about = b"1 0 Org\nURL IP-address Archive-date Content-type Archive-length\n"
    v1 = b"filedesc://x.arc 0 19960923142103 text/plain %d\n%s\n" % (len(about), about)
    data = v1 + b"http://h/ 1.2.3.4 199609 text/html %d\n%s\n\n" % (len(body), body)
    (fields, content), = archives.arc_records(io.BytesIO(data))
    assert bytes(content) == body and fields["URL"] == "http://h/" and archives.warc_date(fields["Archive-date"]) == "1996-09-01T00:00:00Z"
    for broken in (data[:-30], v1 + b"http://h/ 1.2.3.4 text/html 3\nabc\n", b"http://h/ 1 1 t 1\na\n", v1 + b"no length\n"):
        with pytest.raises(ValueError):
            list(archives.arc_records(io.BytesIO(broken)))
    assert archives.split_http(b"no head")[0] == b""


# --- quotations


def test_quotes_are_parsed():
    own, quoted = quotes.parse("Hi\nOn Monday Ann wrote:\n> a\n> b\n>> deep\n> c\nmy answer\n> d")
    assert own == ["Hi", "my answer"] and quoted == [(1, ["a", "b"]), (2, ["deep"]), (1, ["c"]), (1, ["d"])]
    assert quotes.parse("> > x\n>>y")[1] == [(2, ["x", "y"])]
    assert quotes.parse("Hi\nAnn wrote:\n\n> a\nyes")[0] == ["Hi", "yes"] and quotes.parse("a b c d e f g wrote:\n> a")[0] == ["a b c d e f g wrote:"]
    assert quotes.parse("On Monday Ann wrote:\nno quote")[0] == ["On Monday Ann wrote:", "no quote"]


def test_replies_are_linked(spark):
    rows = [
        (1, 0, "a", "First question here.\nSecond line of it."),
        (1, 1, "b", "An unrelated thought."),
        (1, 2, "c", "Ann wrote:\n> First question here.\n> Second line of it.\nAn answer."),
        (1, 3, "a", "> An answer.\n>> first  QUESTION here.\nThanks."),
        (1, 4, "d", "> second line of it.\n> never said\nJust one line."),
        (1, 5, "e", "> nobody said this\nhm"),
        (1, 6, "f", "> Just one line.\nok"),
        (2, 0, "a", "> First question here.\nother conversation"),
        (None, 1, "x", "> First question here."),
        (1, None, None, None),
        (1, 6, "f", "> Just one line.\nok"),
    ]
    df = spark.createDataFrame([(*r, "?", "?") for r in rows], "conv_id long, turn long, role string, text string, parent string, own string")
    got = {(r.conv_id, r.turn): r for r in quotes.linked_conversations(df).collect()}
    assert {k: (r.parent, r.root, r.depth) for k, r in got.items()} == {
        (1, 0): (None, 0, 0), (1, 1): (None, 1, 0), (1, 2): (0, 0, 1), (1, 3): (2, 0, 2), (1, 4): (0, 0, 1), (1, 5): (None, 5, 0), (1, 6): (4, 0, 2),
        (2, 0): (None, 0, 0), (None, 1): (None, 1, 0), (1, None): (None, None, 0),
    }
    assert got[1, 2].text == "An answer." and got[1, 3].text == "Thanks." and got[1, 3].formatted == "<|a|>\nThanks."
    assert quotes.linked_conversations(df).count() == len(rows) and quotes.linked_conversations(df.limit(0)).count() == 0


def test_long_chain_of_replies(spark):
    rows = [(1, i, "u", (f"> word{i - 1} said\n" if i else "") + f"word{i} said") for i in range(70)]
    got = {r.turn: (r.root, r.depth, r.position) for r in quotes.linked_conversations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    assert got == {i: (0, i, i) for i in range(70)}


def random_mails(rng, n):
    """Conversations whose messages quote earlier ones in whole, in part, nested or not at all, some with equal words."""
    rows = []
    for c in range(n):
        own, said = [], ["same words for all", "a line\nand another one\n\na paragraph"]
        for t in sorted(rng.sample(range(9000), rng.randint(1, 9))):
            text = rng.choice([*said, f"message {t} of {c}\nwith a second line {t}", f"para {t}\n\nthen {t}", "", "  \n"])
            lines = []
            for _ in range(rng.choice([0, 1, 1, 2])):
                if own:
                    other = rng.choice(own)
                    some = other.split("\n") if rng.random() < 0.6 else [rng.choice(other.split("\n"))]
                    marks = rng.choice(["> ", ">", ">> ", "> > ", " > "])
                    lines += rng.choice([[], ["Ann wrote:"], ["On May 1, Bob wrote:", ""]]) + [marks + x.upper() for x in some]
            if rng.random() < 0.2:
                lines.append("> never said " + str(t))
            rows.append((c, t, rng.choice(["user", None]), "\n".join([*lines, *text.split("\n")])))
            own.append(text)
    return rows


def threads_by_hand(rows):
    """parent, root, depth and position by turn, each quoted passage held as text against every earlier message."""
    words = lambda x: tuple(x.lower().split())
    out = {}
    for c in {r[0] for r in rows}:
        seen, parent = {}, {}
        for _, t, _, text in sorted(r for r in rows if r[0] == c):
            marked = [re.match(r"[ \t]*((?:>[ \t]*)*)(.*)", x, re.DOTALL) for x in text.split("\n")]
            groups = [(k, [m[2] if k else m[0] for m in g]) for k, g in itertools.groupby(marked, lambda m: m[1].count(">"))]
            own, wanted = [], []
            for i, (k, lines) in enumerate(groups):
                if k:
                    wanted += [(k, 0, words(" ".join(lines)))] + [(k, 1, words(x)) for x in lines if len(lines) > 1]
                elif i + 1 < len(groups):
                    full = [j for j, x in enumerate(lines) if x.strip()]
                    own += lines[: full[-1]] if full and lines[full[-1]].endswith("wrote:") else lines
                else:
                    own += lines
            found = [(k, part, s) for k, part, w in wanted if w for s, whole in sorted(seen.items()) if w in whole]
            if found:
                parent[t] = min(found)[2]
            paragraphs = re.split(r"\n\s*\n", "\n".join(own))
            seen[t] = {words(x) for x in ["\n".join(own), *paragraphs, *own]} - {()}
        kids = {}
        for t in sorted(parent):
            kids.setdefault(parent[t], []).append(t)

        def walk(t, root, depth, at):
            out[c, t] = (parent.get(t), root, depth, at)
            at += 1
            for k in kids.get(t, []):
                at = walk(k, root, depth + 1, at)
            return at

        for t in seen:
            if t not in parent:
                walk(t, t, 0, 0)
    return out


def test_threads_like_brute_force(spark):
    rows = random_mails(random.Random(5), 60)
    wanted = threads_by_hand(rows)
    out = quotes.linked_conversations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()
    assert {(r.conv_id, r.turn): (r.parent, r.root, r.depth, r.position) for r in out} == wanted
    assert sum(p is not None for p, *_ in wanted.values()) > 60 and max(d for _, _, d, _ in wanted.values()) > 1
    assert not any(line.lstrip().startswith(">") for r in out for line in r.text.split("\n"))


def test_many_replies_to_one_message(spark):
    """Replies in several buckets of turns, and a reply of a reply between them; a very long message."""
    rows = [(1, 0, "u", "the first"), *((1, t, "u", "> the first\nanswer " + str(t)) for t in range(2, 20_000, 900)), (1, 5000, "u", "> answer 2\nlate " + "x" * 300_000)]
    got = {r.turn: (r.parent, r.position) for r in quotes.linked_conversations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    order = [0, 2, 5000, *range(902, 20_000, 900)]
    assert [t for t, _ in sorted(got.items(), key=lambda x: x[1][1])] == order and got[5000][0] == 2


def test_links_of_quoted_conversations(spark, data, duck, rows_of):
    """Known parents are found: recall and precision against the messages that were quoted."""
    assert rows_of(quoted_conversations(spark, data).toArrow()) == rows_of(duck.sql(QUOTED).to_arrow_table())
    got = {(r.conv_id, r.turn): r.parent for r in quoted_conversations(spark, data).collect()}
    right = sum(p == (c * 7 + t * t * 3) % t for (c, t), p in got.items() if t and p is not None)
    linked = sum(p is not None for p in got.values())
    assert right >= 0.9 * linked and right >= 0.9 * sum(t > 0 for _, t in got)


def test_quotations_against_sql(spark, data, duck, rows_of):
    assert rows_of(op5_quotation_links(spark, data).toArrow()) == rows_of(duck.sql(OP5).to_arrow_table())
    import duckdb

    rows = random_mails(random.Random(6), 30)
    for frame in (spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"), quoted(spark.read.parquet(f"{data}/conversations.parquet"))):
        con = duckdb.connect()
        con.register("conversations", frame.toArrow())
        out = quotes.linked_conversations(frame)
        mine = out.selectExpr("conv_id", "turn", "role", "parent", "root", "depth", "position", "n_quotes", "max_level", "sha2(formatted, 256) AS formatted_sha256")
        assert rows_of(mine.toArrow()) == rows_of(con.sql(OP5).to_arrow_table())


# --- pipeline


def followed(spark, data, texts, docs):
    """Each stage against its operator's own brute-force version, stage by stage; the ids that the last one keeps."""
    from test_text_operators import contaminated, lines_removed, stats_of

    columns, kept = docs.columns, dict(texts)
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["quality", "lines", "near_duplicates", "decontamination", "encoding"]
    now = {}
    for name in list(stages)[:4]:
        docs = stages[name](spark, docs, data)
        assert docs.columns == columns
        docs = spark.createDataFrame(docs.toPandas(), docs.schema)
        now[name] = {r.doc_id: r.text for r in docs.collect()}
    assert set(now["quality"]) < set(kept) and all(kept[i] == t for i, t in now["quality"].items())
    for i in now["quality"]:
        n, repeated = stats_of(kept[i])[0], stats_of(kept[i])[4]
        assert n >= 50 and 100 * repeated <= 50 * n
    gone = lines_removed(list(now["quality"].items()))
    for i, t in now["quality"].items():
        left = "\n".join(x for n, x in enumerate(t.split("\n")) if (i, n) not in gone)
        assert now["lines"].get(i, "") == left or i not in now["lines"] and not left.split()
    groups = {i: c for i, _, c in components([(i, simhash.fingerprint(t)) for i, t in now["lines"].items()])}
    assert now["near_duplicates"] == {i: t for i, t in now["lines"].items() if groups[i] == i}
    import duckdb

    items = duckdb.sql(f"SELECT item_id, text FROM read_parquet('{data}/benchmark.parquet')").fetchall()
    dirty = {r[0] for r in contaminated(list(now["near_duplicates"].items()), items) if r[-1]}
    assert now["decontamination"] == {i: t for i, t in now["near_duplicates"].items() if i not in dirty}
    last = stages["encoding"](spark, docs, data).collect()
    assert {r.doc_id for r in last} == set(now["decontamination"])
    return set(now["decontamination"])


def test_pipeline(spark, data, texts):
    kept = followed(spark, data, texts, spark.read.parquet(f"{data}/documents.parquet"))
    assert {r.doc_id for r in corpus_pipeline.run(spark, data).collect()} == kept


def test_pipeline_on_odd_rows(spark, data, odd_rows):
    """Null, empty, wordless, very long and repeated texts under ids of their own."""
    rows = [(100 + n, t) for n, (_, t) in enumerate(odd_rows)]
    docs = spark.createDataFrame([(i, t, None, None, None) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    assert followed(spark, data, [(i, t) for i, t in rows], docs)


def test_stages_on_odd_rows(spark, none, odd_rows, data):
    """Repeated and null ids: none is lost that the stage doesn't reject, and an id keeps one text at most behind near_duplicates."""
    kinds = "doc_id long, text string, lang string, source string, n_chars long"
    odd = spark.createDataFrame([(i, t, None, None, None) for i, t in odd_rows], kinds)
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, none, data).count() == 0
        ids = [r.doc_id for r in stage(spark, odd, data).select("doc_id").collect()]
        if name == "near_duplicates":
            assert len(set(ids) - {None}) == len([i for i in ids if i is not None]) and ids.count(None) == 2
        elif name in ("decontamination", "encoding"):
            assert sorted(ids, key=str) == sorted((i for i, _ in odd_rows), key=str)
        else:
            assert ids


def test_nothing_is_left_behind(spark, odd, data):
    """Tables that a result reads stay until it was read; then clean() removes them. All others go with the operator."""
    import os

    from tessavox.llm import line_dedup, sanitise, sentence_spans
    from tessavox.llm.common import clean, shared_dir

    folder = shared_dir(spark).removeprefix("file://")
    clean(spark)
    before = set(os.listdir(folder))
    for run in (simhash.near_duplicates, simhash.deduplicated, line_dedup.line_dedup, sentence_spans.substring_dedup, sanitise.sanitisation):
        out = run(odd)
        assert len(set(os.listdir(folder)) - before) <= 3, run
        out.count()
        clean(spark)
        assert set(os.listdir(folder)) == before, run
    assert corpus_pipeline.run(spark, data).count()
    assert len(set(os.listdir(folder)) - before) == 1
    clean(spark)
    assert set(os.listdir(folder)) == before
