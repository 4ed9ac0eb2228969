import lzma
import zipfile

import pytest

from lexweave.sources import lists as L
from lexweave.sources import texts as X


def rows(df):
    return {r.form: (r["head"], r["rank"]) for r in df.collect()}


def test_ranked_csv(spark, tmp_path):
    (tmp_path / "l.csv").write_text('rank,word\n1,The\n2,"mom (mommy, mum)"\n3,the\nx,no\n')
    assert rows(L.ranked_csv(spark, str(tmp_path / "l.csv"))) == {"the": ("the", 1), "mom": ("mom", 2), "mommy": ("mommy", 2), "mum": ("mum", 2)}


def test_ranked_with_forms(spark, tmp_path):
    (tmp_path / "s.csv").write_text("Lemma,SFI Rank,x\nabandon,2,a\nthe,1,b\nbad,,c\n")
    (tmp_path / "f.csv").write_text("## note\nabandon,abandoned,abandons\nother,others\n")
    assert rows(L.ranked_with_forms(spark, str(tmp_path / "s.csv"), str(tmp_path / "f.csv"))) == {"abandon": ("abandon", 2), "the": ("the", 1), "abandoned": ("abandon", 2), "abandons": ("abandon", 2)}


def test_headword_bands(spark, tmp_path):
    (tmp_path / "headwords 1st 1000.txt").write_text("the\nof\n\nand\n")
    (tmp_path / "headwords 2nd 1000.txt").write_text("of\nzeal\n")
    assert rows(L.headword_bands(spark, str(tmp_path))) == {"the": ("the", 1), "of": ("of", 2), "and": ("and", 4), "zeal": ("zeal", 1002)}


def test_family_table(spark):
    df = spark.createDataFrame([(1, "1k", "accept", "accepted (4), accepting (2)", "9"), (2, "2K", "xray", "xrays (1)", "1"), (3, "note", "no", "", "")], "o int, `List x` string, Headword string, `Related forms` string, `Total frequency` string")
    assert rows(L.family_table(df, "o")) == {"accept": ("accept", 1), "accepted": ("accept", 1), "accepting": ("accept", 1), "xray": ("xray", 1001), "xrays": ("xray", 1001)}
    with pytest.raises(ValueError):
        L.family_table(df.drop("Headword"), "o")


def test_baseword_files(spark, tmp_path):
    (tmp_path / "basewrd1.txt").write_text("\tlead\nable 0\n\tability 0\n\table 0\n## x\n")
    (tmp_path / "basewrd10.txt").write_text("zeta\n\tzetas\n\tability\n")
    got = rows(L.baseword_files(spark, str(tmp_path)))
    assert got == {"lead": ("lead", 1), "able": ("able", 2), "ability": ("able", 2), "zeta": ("zeta", 1001), "zetas": ("zeta", 1001)}


def test_family_index(spark, tmp_path):
    (tmp_path / "basewrd1.txt").write_text("able 0\n\tability 0\nbe 0\n")
    (tmp_path / "basewrd2.txt").write_text("zeta 0\n\tability 0\ncat 0\n")
    ix = L.family_index(spark, str(tmp_path), bands=2).cache()
    assert rows(ix) == {"able": ("able", 1), "ability": ("able", 1), "be": ("be", 2), "zeta": ("zeta", 1001), "cat": ("cat", 1002)}
    assert L.index_faults(ix, 2, 2).count() == 0 and {r.rule for r in L.index_faults(ix, 2, 3).collect()} == {"families_in_band"}
    with pytest.raises(ValueError):
        L.family_index(spark, str(tmp_path), bands=3)
    (tmp_path / "basewrd2.txt").write_text("\tx\n")
    with pytest.raises(ValueError):
        L.family_index(spark, str(tmp_path), bands=2)


def test_wordnet_xml(spark, tmp_path):
    (tmp_path / "w.xml").write_text("""<LexicalResource><Lexicon>
<LexicalEntry id="e1"><Lemma writtenForm="bank" partOfSpeech="n"/><Sense id="s1" synset="x1"/><Sense id="s2" synset="x2"/></LexicalEntry>
<LexicalEntry id="e2"><Lemma writtenForm="blue" partOfSpeech="s"/><Sense id="s3" synset="x3"/></LexicalEntry>
<Synset id="x1" partOfSpeech="n"><SynsetRelation relType="hypernym" target="x2"/><SynsetRelation relType="similar" target="x3"/></Synset>
<Synset id="x2" partOfSpeech="n"></Synset><Synset id="x3" partOfSpeech="s"></Synset></Lexicon></LexicalResource>""")
    nodes, edges, links = L.wordnet_xml(spark, str(tmp_path / "w.xml"))
    assert {tuple(r) for r in nodes.collect()} == {("x1", "n"), ("x2", "n"), ("x3", "a")} and [tuple(r) for r in edges.collect()] == [("x1", "x2")]
    assert {tuple(r) for r in links.collect()} == {("bank", "n", "x1"), ("bank", "n", "x2"), ("blue", "a", "x3")}


def test_checked_csv(spark, tmp_path):
    head = "lemma,pos,polysemy,depth_sense_count,hypernym_depth_min,hypernym_depth_mean,hypernym_depth_max\n"
    (tmp_path / "m.csv").write_text(head + "bank,n,2,2,1,1.5,2\nblue,a,1,0,,,\n")
    assert L.lemma_metrics(spark, str(tmp_path / "m.csv")).count() == 2
    (tmp_path / "d.csv").write_text(head + "bank,n,2,2,1,1.5,2\nbank,n,1,0,,,\n")
    with pytest.raises(ValueError):
        L.lemma_metrics(spark, str(tmp_path / "d.csv"))


@pytest.mark.parametrize("xz", [False, True])
def test_exposure_tsv(spark, tmp_path, xz):
    text = 'word\tcount\tvideos\tchannels\tcount:a\n"odd\t3\t2\t1\t3\nb\t3\t4\t1\t3\n[TOTAL]\t9\t5\t4\t9\n'
    p = tmp_path / ("t.tsv.xz" if xz else "t.tsv")
    p.write_bytes(lzma.compress(text.encode()) if xz else text.encode())
    parsed, total = L.exposure_tsv(spark, str(p), ["a"])
    assert sorted((r.word or "", r.reason or "") for r in parsed.collect()) == [("", "videos_over_count"), ('"odd', ""), ("[TOTAL]", "")]
    assert total.first()["count"] == 9
    with pytest.raises(ValueError):
        L.exposure_tsv(spark, str(p), ["z"])


def test_unsorted_and_catalog(spark):
    df = spark.createDataFrame([(0, "a"), (1, "b"), (2, "b"), (200_000, "a")], "o long, word string")
    assert {r.o for r in L.unsorted_words(df, "o").collect()} == {2}
    c = L.ListCatalog()
    c.register("x", lambda s: df, "CC0")
    c.register("y", lambda s: df, "closed", usable=False)
    assert c.load(spark, "x").count() == 4 and [n for n, _, _ in c.names()] == ["x", "y"]
    for name, error in (("y", PermissionError), ("z", KeyError)):
        with pytest.raises(error):
            c.load(spark, name)


def test_texts_and_archives(spark, tmp_path):
    d = tmp_path / "in"
    (d / "b").mkdir(parents=True)
    (d / "a.txt").write_bytes(b"caf\xc3\xa9 \xff")
    (d / "b" / "a.txt").write_text("two")
    (d / "c.pdf").write_text("x")
    (d / "big.txt").write_text("y" * 100)
    got = {r.name: (r.text, r.warning) for r in X.text_files(spark, str(d), most_bytes=50).collect()}
    assert got == {"a.txt": ("café �", None), "a.txt (2)": ("two", None), "c.pdf": (None, "not a text file"), "big.txt": (None, "too large")}
    z = tmp_path / "z"
    z.mkdir()
    with zipfile.ZipFile(z / "k.zip", "w", zipfile.ZIP_DEFLATED) as f:
        for n, t in (("b.txt", "B"), ("a.txt", "A"), ("../evil.txt", "E"), ("n.md", "M"), ("__MACOSX/a.txt", "-"), ("bomb.txt", "0" * 1_000_000)):
            f.writestr(n, t)
    (z / "bad.zip").write_text("nope")
    got = [(r.member, r.text, r.warning) for r in X.zip_texts(spark, str(z)).collect() if r.archive.endswith("k.zip")]
    assert got == [("../evil.txt", None, "unsafe name"), ("a.txt", "A", None), ("b.txt", "B", None), ("bomb.txt", None, "member over its limits"), ("n.md", None, "ignored")]
    assert {r.warning for r in X.zip_texts(spark, str(z), X.ArchiveLimits(members=2)).collect()} == {"not an archive", "archive over its limits"}
