import numpy as np

from quire.operators import outlines, rasters

TINT = (0xD0, 0xE0, 0xE3)


def solid(w, h, colour):
    return np.full((h, w, 3), colour, np.uint8)


def test_letterbox_and_padding():
    out = rasters.letterboxed(solid(300, 300, (0, 0, 0)), 400, 300, np.array([255, 255, 255]))
    assert (out[:, :50] == 255).all() and (out[:, 350:] == 255).all() and (out[:, 50:350] == 0).all()
    framed = solid(300, 300, TINT)
    framed[[0, -1]] = framed[:, [0, -1]] = 255
    assert tuple(rasters.pad_colour(framed, 400, 300)) == TINT and tuple(rasters.pad_colour(framed, 300, 300)) == (255, 255, 255)
    assert rasters.scaled(solid(37, 21, TINT), 80, 50).reshape(-1, 3).tolist() == [list(TINT)] * 4000
    assert rasters.fitted(3514, 2025, 2560, 1366) == (2370, 1366)


def test_flattening_keeps_content():
    img = solid(200, 100, TINT)
    img[20:40, 20:60] = 30
    colour, grey, cover, active = rasters.background(img)
    assert tuple(colour) == TINT and grey == 221 and cover == 96 and active
    out, flat = rasters.page(img, 200, 100, True, True)
    assert flat and set(np.unique(out)) == {30, 255} and (out[20:40, 20:60] == 30).all()
    assert set(np.unique(rasters.page(img, 200, 100, False, True)[0])) == {30, 255}
    assert not rasters.background(solid(9, 9, (20, 20, 20)))[3]


def test_pages(spark):
    img = solid(30, 30, (0, 0, 0))
    df = spark.createDataFrame([(7, 30, 30, bytearray(img.tobytes()), 40, 30)], "image_id long, w int, h int, data binary, canvas_w int, canvas_h int")
    r = rasters.pages(df, grey=True).first()
    assert (r.w, r.h, r.channels, len(r.data), r.flattened) == (40, 30, 1, 1200, False)


def test_outlines(spark):
    rows = [(1, 1, None, 0, "A\x07  b", 3), (1, 2, None, 1, " ", -1), (1, 3, 2, 0, "child", 5), (1, 4, None, 2, "gone", -1), (1, 5, None, 3, "", 0), (1, 6, 4, 0, "gone too", None)]
    got = outlines.tidy(spark.createDataFrame(rows, "book_id long, entry_id long, parent_id long, ord long, title string, page long"))
    assert {(r.entry_id, r.title, r.page) for r in got.collect()} == {(1, "A b", 3), (2, "6", 5), (3, "child", 5), (5, "1", 0)}
    assert outlines.counted(got).first().entries == 4
    assert outlines.nested(got).first().markup.startswith('<ol><li><a href="004.xhtml">A b</a></li><li><a href="006.xhtml">6</a><ol><li>')
