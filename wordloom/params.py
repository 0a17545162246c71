"""Parameters that the registered queries and their SQL share."""

#: Frequent words of the corpus, used as seeds.
SEED, SEED2, OTHER, SCOPE = "tion", "ther", "ing", "er"
#: Rows of a frequency list; a page's offset and length.
FREQUENT, PAGE = 50, (5, 20)
#: Least sentences of a word in a cluster.
MIN_DF = 20
#: Stop words of the query that gives its own.
OWN_STOP_WORDS = ("tion", "er", "the")
#: Second seed of a path of clusters; the word of a raw cluster.
NEXT, RAW = "er", "der"
TFIDF_RANGE = (0.05, 0.4)
#: A text with links in all the forms that are taken out, as SQL over ``pages``.
URLS = "'See ' || url || ' and [t](' || url || ') or www.x.org/a?b awww.b ftp://h/f end' || page_id"
