"""The smallest tables, and rows as comparable text."""

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def same(columns, rows):
    """Rows as comparable text, columns by name; floats to six places."""
    order = sorted(range(len(columns)), key=lambda i: columns[i])

    def cell(v):
        if isinstance(v, float):
            return f"{round(v, 6) + 0.0:.6f}"
        return repr(v)

    return sorted("|".join(cell(r[i]) for i in order) for r in rows)
