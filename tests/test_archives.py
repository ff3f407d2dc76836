"""Archives of tables and their gazetteer, against plain loops."""

import io
import random
import zipfile

import pytest

from leadloom.sources import archives


def code_line(rng, country, k):
    line = [country, f"{k:05d}", rng.choice(["Ruda", " Plock ", ""]), rng.choice(["North", "South", ""]), rng.choice(["01", "02", ""]), *"....", *rng.choice([("50.5", "19.25"), ("", "1"), ("x", "1"), ("nan", "2"), ("51", "20")]), "6"]
    return rng.choice(["\t".join(line)] * 8 + ["\t".join(line[:7]), "", "  "])


def place_line(rng, country, k):
    line = [str(k), rng.choice(["Ruda", "Plock", ""]), "", "", *rng.choice([("50.5", "19.25"), ("", "1"), ("51", "y")]), rng.choice("PPPHT"), "", country.lower(), "", rng.choice(["01", "02", "09", ""]), "", "", "", rng.choice(["100", "", "-5", "abc", "12345678901234567890123"]), "rest"]
    return rng.choice(["\t".join(line)] * 8 + ["\t".join(line[:9]), ""])


def usable(lat, lng):
    try:
        return abs(float(lat)) < 1000 and abs(float(lng)) < 1000
    except ValueError:
        return False


def brute(codes, places):
    """(gazetteer rows, skipped codes, skipped places) from lists of (path, lines)."""
    out, regions, lost = set(), {}, [0, 0]
    for _, lines in sorted(codes):
        for w in (x.split("\t") for x in lines if x.strip()):
            if len(w) < 11 or not usable(w[9], w[10]):
                lost[0] += 1
                continue
            if w[3].strip() and w[4].strip():
                regions.setdefault((w[0].upper(), w[4].strip()), w[3].strip())
            out.add((w[0].upper(), w[1], w[2].strip(), w[3].strip(), float(w[9]), float(w[10]), None))
    for _, lines in places:
        for w in (x.split("\t") for x in lines if x.strip()):
            if len(w) < 15:
                lost[1] += 1
            elif w[6] == "P":
                if not w[1] or not usable(w[4], w[5]):
                    lost[1] += 1
                    continue
                people = int(w[14]) if w[14].isdigit() and int(w[14]) < 2**63 else 0
                out.add((w[8].upper(), "", w[1], regions.get((w[8].upper(), w[10]), ""), float(w[4]), float(w[5]), people))
    return out, *lost


def write(folder, tables):
    folder.mkdir()
    for path, lines in tables:
        with zipfile.ZipFile(folder / path, "w", zipfile.ZIP_DEFLATED) as z:
            z.writestr("readme.txt", "no table\n")
            z.writestr(path.replace(".zip", ".TXT"), "\r\n".join(lines))


@pytest.mark.parametrize("piece", [3, 10_000])
def test_gazetteer_equals_loops(spark, tmp_path, monkeypatch, piece):
    monkeypatch.setattr(archives, "PIECE", piece)
    rng = random.Random(piece)
    codes = [(f"{c}.zip", [code_line(rng, c, k) for k in range(60)]) for c in ("PL", "DE", "cz")]
    places = [(f"{c}.zip", [place_line(rng, c, k) for k in range(60)]) for c in ("PL", "DE", "cz")]
    write(tmp_path / "codes", codes)
    write(tmp_path / "places", places)
    packed = [archives.lines(archives.archives(spark, f"file://{tmp_path}/{x}")) for x in ("codes", "places")]
    want, lost_codes, lost_places = brute(codes, places)
    found = [tuple(r) for r in archives.gazetteer(*packed).collect()]
    assert len(found) == len(set(found)) and set(found) == want
    assert {r["table"]: r["skipped"] for r in archives.skipped(*packed).collect()} == {"codes": lost_codes, "places": lost_places}


def test_archives_that_cannot_be_read(spark):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("other.txt", "a\tb\n")
    whole = io.BytesIO()
    with zipfile.ZipFile(whole, "w") as z:
        z.writestr("c.txt", "one\n\ntwo\n")
    rows = spark.createDataFrame([("x/a.zip", bytearray(b"no archive")), ("x/b.zip", bytearray(out.getvalue())), ("x/c.zip", bytearray(whole.getvalue()))], "path string, content binary")
    found = archives.lines(rows).collect()
    assert [(r["number"], r["line"]) for r in found if r["failed"] is None] == [(0, "one"), (2, "two")]
    assert sorted(r["path"] for r in found if r["failed"]) == ["x/a.zip", "x/b.zip"]
    assert archives.gazetteer(archives.lines(rows.limit(0)), archives.lines(rows.limit(0))).collect() == []


def test_a_task_holds_a_piece(monkeypatch):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("a.txt", "x\ty\n" * 25_000)
    assert [len(f) for f in archives._unpacked("a.zip", out.getvalue())] == [10_000, 10_000, 5_000]
