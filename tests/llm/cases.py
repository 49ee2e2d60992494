"""Small tables with the awkward rows that every operator must take."""

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size long, shard string"
PROSE = "the river ran past the old mill and the children watched it turn in the evening light while birds sang"
LONG = " ".join(f"word{i % 977} of{i % 31}" for i in range(30_000))


def rows():
    texts = [None, "", " \t\n ", PROSE, PROSE, PROSE + " again", "one", "one two three", LONG, "zwölf Boxkämpfer jagen Viktor quer über den großen Sylter Deich 　 und zurück"]
    out = [(i, t, "en" if i % 3 else None, f"src{i % 2}" if i != 3 else None, None if t is None else len(t), i, "x") for i, t in enumerate(texts)]
    return out + [out[4], out[4], (None, "no id here at all", "en", "src0", 17, 1, "y")]


def frame(spark):
    return spark.createDataFrame(rows(), SCHEMA)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def values(df, *columns):
    """Sorted rows; null before all else."""
    return sorted((tuple(r[c] for c in columns or df.columns) for r in df.collect()), key=lambda r: tuple((x is not None, str(type(x)), x) for x in r))
