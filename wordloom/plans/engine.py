"""One object over a corpus: lazy plans in, DataFrames out."""

from __future__ import annotations

import uuid
from collections import OrderedDict
from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame

from ..functions.normalize import STOP_WORDS
from ..operators import association, corpus, exclusive, search, tfidf, views
from ..operators.prepared import Prepared, prepare
from ..shared import Files, shared_dir
from ..sources.datasets import get_source, read_csv, resolve_cap
from ..sources.store import SentenceStore, export_scores

#: Changes when sentences or tokens would come out differently.
VERSION = "2"


class TextEngine:
    """Queries over a prepared corpus: its tables are written once and only read from then on.

    Clusters and paths that were asked for are kept as tables too: all of the corpus once, and the
    latest RECENT paths. ``close`` removes everything."""

    RECENT = 20

    def __init__(self, sentences: DataFrame, association_enabled: bool = True) -> None:
        self.association_enabled = association_enabled
        self.folder = f"{shared_dir(sentences.sparkSession)}/wordloom-engine-{uuid.uuid4().hex}"
        self.tables: Prepared = prepare(sentences, f"{self.folder}/corpus")
        self.sentences = self.tables.sentences
        self._kept: OrderedDict[tuple[str, ...], DataFrame] = OrderedDict()

    @classmethod
    def from_documents(cls, documents: DataFrame, stop_words: list[str] | None = None, association_enabled: bool = True) -> TextEngine:
        """From documents(doc_index, text)."""
        return cls(corpus.sentences(documents, stop_words if stop_words is not None else STOP_WORDS), association_enabled)

    @classmethod
    def load(cls, store: SentenceStore, key: str, path: str, max_documents: int | None = None) -> TextEngine:
        """From the store if it holds this file, variant and cap; else read, prepared and saved."""
        source = get_source(key)
        cap = resolve_cap(source, max_documents)
        version = f"{VERSION}:{source.variant}:max={cap or 'all'}"
        rows = store.cached(path, version, ordered=False)
        if rows is None:
            found = corpus.dense_ids(corpus.sentences(read_csv(store.spark, path, source, cap or 0)))
            store.save(source.key, path, version, found)
            rows = store.cached(path, version, ordered=False)
        return cls(corpus.from_processed(rows))

    def close(self) -> None:
        Files(self.sentences.sparkSession).delete(self.folder)
        self._kept.clear()

    def _keep(self, key: tuple[str, ...], made: Callable[[], DataFrame]) -> DataFrame:
        if key not in self._kept:
            path = f"{self.folder}/kept-{uuid.uuid4().hex}"
            made().write.parquet(path)
            self._kept[key] = self.sentences.sparkSession.read.parquet(path)
            paths = [k for k in self._kept if k]  # the empty path is the whole corpus and stays
            if len(paths) > self.RECENT:
                Files(self.sentences.sparkSession).delete(self._kept.pop(paths[0]).inputFiles()[0].rsplit("/", 1)[0])
        self._kept.move_to_end(key)
        return self._kept[key]

    # search
    def search(self, word: str, state: search.SearchState = search.SearchState()) -> search.SearchState:
        return state.narrowed(word)

    def matches(self, state: search.SearchState) -> DataFrame:
        return search.matches(self.sentences, state)

    def related(self, state: search.SearchState, n: int | None = None) -> DataFrame:
        return corpus.most_frequent(search.related(self.sentences, state), n)

    def described(self, state: search.SearchState, n: int = 20) -> str:
        """A few matches and related words, as text."""
        ids = ", ".join(str(r["sid"]) for r in self.matches(state).orderBy("sid").limit(n).collect())
        words = ", ".join(f"{r['word']} ({r['df']})" for r in self.related(state, n).collect())
        return f"words: {' '.join(state.words)}\nsentences: {ids}\nrelated: {words}"

    def word_frequencies(self, n: int | None = None) -> DataFrame:
        return corpus.most_frequent(self.tables.vocab, n)

    def posting(self, word: str) -> DataFrame:
        """(sid, tf) of a word, from its part of the index."""
        return self.tables.of_word(word).select("sid", "tf")

    def top_words(self, n: int) -> DataFrame:
        """(word, df, mean_tfidf) of the most frequent words."""
        return tfidf.means_of(self.sentences, self.word_frequencies(n), self.tables.terms)

    def export_top_words(self, n: int, path: str) -> str:
        return export_scores(self.top_words(n), path, score="mean_tfidf")

    # association
    def cluster(self, seed: str, options: association.Options = association.Options(), scope: DataFrame | None = None) -> DataFrame:
        if not self.association_enabled:
            raise RuntimeError("association clusters are disabled")
        found, words, known = self.sentences, None, None
        if scope is not None:
            found = found.join(scope.select("sid"), "sid", "left_semi")
        else:
            words, known = corpus.lower_vocab(self.tables.vocab, found), self.tables.terms
        scores = tfidf.word_means(found, known) if options.tfidf_range else None
        return association.cluster(found, seed, options, scores, words)

    def cluster_by_frequency(self, seed: str, options: association.Options = association.Options(min_score_percent=30.0), top_n: int = 20, of: int = 100) -> DataFrame:
        """The best ``of`` by score, the top of them by document frequency, with the statistics of those."""
        rows = association.by_frequency(self.cluster(seed, replace(options, top_n=of)), "df", top_n)
        return association.with_statistics(rows)

    def cluster_in_path(self, path: list[str], seed: str, options: association.Options = association.Options()) -> DataFrame:
        """Within the sentences that hold the whole path: statistics anew, no percent filter, path words left out, by co-occurrence."""
        scope = search.containing(self.sentences, path).select("sid")
        rows = self.cluster(seed, replace(options, top_n=100, min_score_percent=0.0, excluded=tuple(path)), scope)
        return association.by_frequency(rows, "cooc", 100)

    def cluster_with_sentences(self, seed: str, options: association.Options = association.Options()) -> DataFrame:
        """Rows of kind word, the cluster, and of kind sentence, the seed's sentences."""
        return association.with_sentences(self.cluster(seed, options), self.sentences, seed)

    # exclusive clusters
    def exclusive(self, n: int | None = None) -> DataFrame:
        """(sid, word); made once for the whole corpus and kept."""
        rows = self._keep((), lambda: exclusive.assigned(self.sentences, known=self.tables.terms))
        return rows if n is None else exclusive.first_n(self.sentences, rows, n)

    def exclusive_in_path(self, seeds: list[str]) -> DataFrame:
        """Iterative clusters along seeds; the latest paths are kept."""
        path = tuple(s.lower().strip() for s in seeds if s.strip())
        if not path:
            raise ValueError("give at least one seed word")
        return self._keep(path, lambda: exclusive.iterated(self.sentences, list(path), self.tables.terms))

    def drilled(self, word: str) -> DataFrame:
        """The raw cluster of a word, clustered anew without it."""
        return exclusive.drilled(self.sentences, word, self.tables.terms)

    # views
    def cluster_sentences(self, word: str, path: list[str] | None = None, offset: int = 0, limit: int = 20) -> DataFrame:
        """A page of an exclusive cluster, of the whole corpus or along seeds, with hits of the path and the word, and the total."""
        seeds = [s for s in path or [] if s.strip()]
        rows = self.exclusive_in_path(seeds) if seeds else self.exclusive()
        ids = rows.where(rows["word"] == word.lower().strip())
        return views.shown(self.sentences, ids, [*seeds, word], offset, limit)

    def path_sentences(self, path: list[str], offset: int = 0, limit: int = 20) -> DataFrame:
        """A page of the sentences that hold all words of a path, with their hits and the total."""
        return views.shown(self.sentences, search.containing(self.sentences, path), path, offset, limit)
