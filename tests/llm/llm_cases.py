"""Cases and brute force shared by the tests."""

#: Rows that every operator must take: nulls, blanks, repeats, ties and a very long text.
EDGE = [
    (1, None),
    (None, None),
    (None, "a null id and some words to go with it"),
    (2, ""),
    (3, " \t\n "),
    (4, "one"),
    (4, "one"),
    (5, "the same text of a few words and then some more words"),
    (6, "the same text of a few words and then some more words"),
    (6, "another text under a used id, with its own few words in it"),
    (7, "word " * 30_000),
    (8, "zwölf Boxkämpfer \U0001f600 jagen 中文 Жук"),
]


def components(n, links):
    group = list(range(n))

    def find(x):
        while group[x] != x:
            x = group[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        group[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]
