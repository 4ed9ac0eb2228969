"""Queries of the file readers: the fixed tables are written out in a reader's format and read back.

The files are made from ``rank_list`` and ``eval_items``, whose size is fixed and checked, so the driver writes them.
"""

from __future__ import annotations

import io
import zipfile

from pyspark.sql import functions as F

from lexweave.plans.registry import Registry
from lexweave.session import table, work_path
from lexweave.sources import lists as L
from lexweave.sources import texts as X

R = Registry()
queries, oracle_sql = R.queries, R.oracle_sql
MOST_ROWS = 20_000


def _put(spark, folder: str, files: dict[str, bytes]) -> str:
    """Write small files into the shared folder."""
    fs = spark.sparkContext._jvm.org.apache.hadoop.fs
    for name, data in files.items():
        path = fs.Path(f"{folder}/{name}")
        out = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(path, True)
        out.write(bytearray(data))
        out.close()
    return folder


def _fixed(df):
    rows = df.limit(MOST_ROWS + 1).collect()
    if len(rows) > MOST_ROWS:
        raise ValueError(f"more than {MOST_ROWS} rows in a table of fixed size")
    return rows


def _families(spark, sf) -> list[tuple[int, str, list[str]]]:
    """(rank, head, other forms) in order of rank."""
    out: dict[tuple[int, str], list[str]] = {}
    for r in _fixed(table(spark, sf, "rank_list").select("form", "head", "rank_no").orderBy("rank_no", "head", "form")):
        forms = out.setdefault((r.rank_no, r["head"]), [])
        if r.form != r["head"]:
            forms.append(r.form)
    return [(rank, head, forms) for (rank, head), forms in out.items()]


_ALL = "a AS (SELECT form, head, rank_no FROM rank_list UNION SELECT head, head, rank_no FROM rank_list)"


@R.query(f"WITH {_ALL} SELECT form, form AS head, rank_no AS rank, ((rank_no - 1) // 1000 + 1)::INT AS level FROM a")
def read_ranked_csv(spark, sf):
    """Lines ``rank,"head (variant, variant)"``; variants stand for themselves at the head's rank."""
    lines = ["rank,word", "x,not a rank"]
    for rank, head, forms in _families(spark, sf):
        lines.append(f'{rank},"{head.title()} ({", ".join(forms)})"' if forms else f"{rank},{head}")
    return L.ranked_csv(spark, _put(spark, work_path(spark, "ranked"), {"list.csv": "\r\n".join(lines).encode()}))


@R.query(f"WITH {_ALL} SELECT form, head, rank_no AS rank, ((rank_no - 1) // 1000 + 1)::INT AS level FROM a")
def read_ranked_with_forms(spark, sf):
    """A statistics table and a table of forms."""
    families = _families(spark, sf)
    stats = "Lemma,SFI Rank,note\n" + "".join(f"{head},{rank},-\n" for rank, head, _ in families) + "unranked,,-\n"
    forms = "## forms\n" + "".join(f"{head},{','.join(f)}\n" for _, head, f in families if f) + "stranger,strangers\n"
    folder = _put(spark, work_path(spark, "two-files"), {"stats.csv": stats.encode(), "forms.csv": forms.encode()})
    return L.ranked_with_forms(spark, f"{folder}/stats.csv", f"{folder}/forms.csv")


@R.query("SELECT DISTINCT head AS form, head, rank_no AS rank, ((rank_no - 1) // 1000 + 1)::INT AS level FROM rank_list")
def read_headword_bands(spark, sf):
    """Files of a thousand lines each; the line is the rank, blank where the list has no such rank."""
    bands: dict[int, list[str]] = {}
    for rank, head, _ in _families(spark, sf):
        bands.setdefault((rank - 1) // 1000, [""] * 1000)[(rank - 1) % 1000] = head
    ordinal = {1: "st", 2: "nd", 3: "rd"}
    files = {f"headwords {b + 1}{ordinal.get(b + 1, 'th')} 1000.txt": "\n".join(words).encode() for b, words in bands.items()}
    return L.headword_bands(spark, _put(spark, work_path(spark, "bands"), files))


_ORDINAL = f"""WITH {_ALL}, f AS (SELECT DISTINCT head, rank_no, (rank_no - 1) // 1000 + 1 AS band FROM rank_list),
 o AS (SELECT head, rank_no, band, row_number() OVER (PARTITION BY band ORDER BY rank_no, head) AS n, dense_rank() OVER (ORDER BY band) AS level FROM f)"""


@R.query(_ORDINAL + " SELECT form, head, ((level - 1) * 1000 + n)::INT AS rank, level::INT AS level FROM a JOIN o USING (head, rank_no)")
def read_basewords(spark, sf):
    """Family files: heads unindented, members indented; ranks count the families of a file."""
    return L.baseword_files(spark, _put(spark, work_path(spark, "basewords"), _band_files(spark, sf)))


@R.query(_ORDINAL + " SELECT form, head, ((level - 1) * 1000 + n)::INT AS rank, level::INT AS level FROM a JOIN o USING (head, rank_no)")
def read_family_table(spark, sf):
    """A sheet with the columns List, Headword, Related forms and Total; rows of other lists are left out."""
    level = {b: i + 1 for i, b in enumerate(sorted({(rank - 1) // 1000 for rank, _, _ in _families(spark, sf)}))}
    rows = [(i, f" {level[(rank - 1) // 1000]}k", head.title(), ", ".join(f"{f} ({k})" for k, f in enumerate(forms)) or None, "1") for i, (rank, head, forms) in enumerate(_families(spark, sf))]
    sheet = spark.createDataFrame([*rows, (len(rows), "offlist", "Nope", None, "0")], "i int, `List` string, `Headword` string, `Related forms` string, `Total frequency` string")
    return L.family_table(sheet, "i")


def _band_files(spark, sf) -> dict[str, bytes]:
    files: dict[int, list[str]] = {}
    for rank, head, forms in _families(spark, sf):
        files.setdefault((rank - 1) // 1000 + 1, []).extend([head, *(f"\t{f} 0" for f in forms)])
    return {f"basewrd{b}.txt": "\n".join(lines).encode() for b, lines in files.items()}


@R.query(_ORDINAL + " SELECT form, head, ((band - 1) * 1000 + n)::INT AS rank, band::INT AS band, n::INT AS family_ordinal FROM a JOIN o USING (head, rank_no)")
def read_family_index(spark, sf):
    """Exactly the band files there are (the list's bands are made to follow each other)."""
    files = _band_files(spark, sf)
    return L.family_index(spark, _put(spark, work_path(spark, "family-index"), files), bands=len(files))


def _items(spark, sf) -> dict[str, bytes]:
    rows = _fixed(table(spark, sf, "eval_items").select("item_id", "text").filter("text is not null"))
    return {f"item {r.item_id}.txt": r.text.encode() for r in rows}


@R.query("SELECT 'item ' || item_id || '.txt' AS name, strlen(text)::BIGINT AS n_bytes, md5(text) AS text_md5, NULL::VARCHAR AS warning FROM eval_items WHERE text IS NOT NULL UNION ALL SELECT 'notes.pdf', 4, NULL, 'not a text file'")
def read_texts(spark, sf):
    files = X.text_files(spark, _put(spark, work_path(spark, "texts"), _items(spark, sf) | {"notes.pdf": b"%PDF"}))
    return files.select("name", "n_bytes", F.md5("text").alias("text_md5"), "warning")


@R.query("SELECT 'part ' || (item_id % 3) || '/item ' || item_id || '.txt' AS member, md5(text) AS text_md5, NULL::VARCHAR AS warning FROM eval_items WHERE text IS NOT NULL UNION ALL SELECT * FROM (VALUES ('readme.md', NULL, 'ignored'), ('../up.txt', NULL, 'unsafe name'))")
def read_zip(spark, sf):
    """Members in folders, one that is no text, one with an unsafe name, one of an archiver's own folder."""
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w", zipfile.ZIP_DEFLATED) as z:
        for name, text in _items(spark, sf).items():
            z.writestr(f"part {int(name[5:-4]) % 3}/{name}", text)
        for name in ("readme.md", "../up.txt", "__MACOSX/x.txt"):
            z.writestr(name, "x")
    got = X.zip_texts(spark, _put(spark, work_path(spark, "zip"), {"a.zip": data.getvalue()}))
    return got.select("member", F.md5("text").alias("text_md5"), "warning")


_EXPOSED = "(SELECT rank_no AS r, head AS word, 3 * rank_no + 6 AS c FROM (SELECT DISTINCT head, rank_no FROM rank_list))"


@R.query(f"SELECT word, c::BIGINT AS count, (c - 1)::BIGINT AS videos, 2::BIGINT AS channels, '{{\"news\":' || (c - 2) || ',\"games\":2}}' AS category_counts FROM {_EXPOSED} UNION ALL SELECT '[TOTAL]', sum(c)::BIGINT, sum(c - 1)::BIGINT, 2, '{{\"news\":' || sum(c - 2)::BIGINT || ',\"games\":' || 2 * count(*) || '}}' FROM {_EXPOSED}")
def read_exposure(spark, sf):
    """An unquoted table of counts made from the ranks, with its total row."""
    rows = [(head, 3 * rank + 6) for rank, head, _ in _families(spark, sf)]
    lines = ["word\tcount\tvideos\tchannels\tcount:news\tcount:games", *(f"{w}\t{c}\t{c - 1}\t2\t{c - 2}\t2" for w, c in rows)]
    total = sum(c for _, c in rows)
    lines.append(f"[TOTAL]\t{total}\t{total - len(rows)}\t2\t{total - 2 * len(rows)}\t{2 * len(rows)}")
    parsed, _ = L.exposure_tsv(spark, f"{_put(spark, work_path(spark, 'exposure'), {'x.tsv': chr(10).join(lines).encode()})}/x.tsv", ["news", "games"])
    return parsed.filter("reason is null").select("word", "count", "videos", "channels", F.to_json("category_counts").alias("category_counts"))
