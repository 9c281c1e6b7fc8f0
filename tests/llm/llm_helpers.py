"""Shared by the tests of the training-data operators."""

SF = "/root/testdata/sf0.001"


def same_rows(frame, reference, sql, digits=9):
    """Compare a DataFrame with the rows of its reference SQL, whatever the order of rows and columns."""
    result = reference.execute(sql)
    columns = [d[0] for d in result.description]
    assert sorted(columns) == sorted(frame.columns)

    def plain(v):
        return round(v, digits) if isinstance(v, float) else v

    ours = sorted((tuple(plain(r[c]) for c in columns) for r in frame.collect()), key=repr)
    assert ours == sorted((tuple(plain(v) for v in r) for r in result.fetchall()), key=repr)
