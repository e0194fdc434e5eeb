"""The two SRT parsers against each other."""

import random

from pyspark.sql import functions as F

from cuespark.operators.native_srt import parse_srt_native
from cuespark.operators.parse import cues_of, parse_files

T = "00:00:0{a},000 --> 00:00:0{b},5"


def corpus():
    rng = random.Random(7)
    files = ["", "\n", " \n\n", "1\n" + T.format(a=1, b=2) + "\na", "\ufeff1\n" + T.format(a=1, b=2) + "\na\n", "\r\n\n 01\t\r\n" + T.format(a=1, b=2) + " x:1\r\r\nb\r"]
    pieces = ["1\n", "22 \n", "x\n", T.format(a=1, b=2) + "\n", T.format(a=2, b=1) + "\n", "00:00:61,0 --> 00:01:00,0\n", "\n", "\u3000\r\n", "é <i>ü</i>&amp;\r\n", "--> \n"]
    for _ in range(400):
        files.append("".join(rng.choices(pieces, k=rng.randrange(1, 9))))
    for _ in range(200):
        blocks = [f"{i}{rng.choice(['', ' ', chr(9)])}\n{T.format(a=rng.randrange(1, 5), b=rng.randrange(5, 9))}\n{rng.choice(['one', 'zwölf\nx', '7', '7\nx'])}\n" for i in range(rng.randrange(1, 6))]
        files.append(rng.choice(["", "\n", "\ufeff"]) + rng.choice(["\n", "\n \n", "\r\n"]).join(blocks))
    return [(f"f{i}.srt", bytearray(x.encode())) for i, x in enumerate(files)] + [("bad.srt", bytearray(b"1\n" + T.format(a=1, b=2).encode() + b"\n\xff\n"))]


def test_same_cues_as_the_kernel(spark):
    files = spark.createDataFrame(corpus(), "path string, content binary").cache()
    columns = ["path", "ordinal", "cue_id", "start_ms", "end_ms", "display_text", "search_text", "delete_span", "index_span"]
    native = sorted(map(str, parse_srt_native(files).select(columns).collect()))
    kernel = sorted(map(str, cues_of(parse_files(files, form=F.lit("srt"))).select(columns).collect()))
    assert len(kernel) > 300
    assert sorted(set(native) - set(kernel))[:3] == sorted(set(kernel) - set(native))[:3] == []
    assert native == kernel
