"""Row comparison of a Spark result with a SQL result."""


def same_rows(df, columns, rows):
    def listed(names, found):
        order = sorted(range(len(names)), key=lambda k: names[k])
        return sorted(tuple(str(r[k]) for k in order) for r in found)

    assert sorted(df.columns) == sorted(columns)
    assert listed(df.columns, df.collect()) == listed(list(columns), rows)
