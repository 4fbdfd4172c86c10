"""The engine: builds an index of a file table, answers searches, stays current."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import asdict, dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.query import expand
from ..operators import chunking, fts, fusion, paths, policy, results, state, vector
from ..sources import files as sources
from ..sources.store import ChunkStore, read_json, write_json

MAX_QUERY, MAX_TOP_K = 1_000, 50


@dataclass
class Config:
    include: tuple[str, ...] = ("**/*",)
    exclude: tuple[str, ...] = ()
    respect_gitignore: bool = True
    max_file_size: str = "1MB"
    max_files: int = 50_000
    doc_patterns: tuple[str, ...] = ("**/*.md", "**/*.txt")
    index_docs: bool = True
    extract_comments: bool = True
    indexing_strategy: str = "realtime"
    chunking_strategy: str = "character"
    default_alpha: float = 0.5
    scorer: str = "auto"
    extra: dict = field(default_factory=dict)

    def __post_init__(self) -> None:
        policy.parse_size(self.max_file_size)
        if self.chunking_strategy not in ("character", "code-aware", "ast"):
            raise ValueError(f"chunking strategy {self.chunking_strategy!r}")
        if self.indexing_strategy not in ("realtime", "lazy", "git"):
            raise ValueError(f"indexing strategy {self.indexing_strategy!r}")


Embedder = Callable[[Column], Column]


class Engine:
    """An index below ``root``: chunks of code and of documents, postings, fingerprints.

    ``embedder`` turns a text column into a vector column (with a pandas UDF around a
    model, for example) and ``embed_query`` one string into a vector; without them search
    is by keywords. Each file belongs to one corpus: documents by ``doc_patterns``, else code.
    """

    def __init__(self, spark: SparkSession, root: str, config: Config | None = None, embedder: Embedder | None = None, embed_query: Callable[[str], Sequence[float]] | None = None, model: str = "none"):
        self.spark, self.root, self.config = spark, root.rstrip("/"), config or Config()
        self.embedder, self.embed_query, self.model = embedder, embed_query, model
        self.code, self.docs, self.prints = (ChunkStore(spark, f"{self.root}/{name}") for name in ("code", "docs", "fingerprints"))

    # building

    def policy(self, gitignore=()) -> policy.Policy:
        c = self.config
        return policy.Policy(tuple(c.include), tuple(c.exclude), tuple(gitignore), policy.parse_size(c.max_file_size), c.respect_gitignore)

    def scan(self, folder: str) -> DataFrame:
        rules = sources.gitignores(self.spark, folder) if self.config.respect_gitignore else ()
        return sources.scan(self.spark, folder, self.policy(rules), self.config.max_files)

    def _is_doc(self) -> Column:
        from ..functions.globs import any_regex

        return F.col("path").rlike(any_regex(list(self.config.doc_patterns)))

    def _chunks(self, files: DataFrame) -> tuple[DataFrame, DataFrame]:
        is_doc = self._is_doc() if self.config.index_docs else F.lit(False)
        code = chunking.chunked(files.where(~is_doc), self.config.chunking_strategy)
        docs = chunking.chunked(files.where(is_doc), "document")
        if self.config.extract_comments:
            notes = chunking.comment_rows(sources.code(files)).drop("of").withColumn("content_hash", F.sha2("text", 256)).withColumn("chunk_hash", F.substring("content_hash", 1, 32))
            docs = docs.unionByName(notes, allowMissingColumns=True)
        return self._embedded(code), self._embedded(docs)

    def _embedded(self, chunks: DataFrame) -> DataFrame:
        """A chunk whose embedding fails (null) stays findable by keywords."""
        return chunks.withColumn("vector", self.embedder(F.col("text"))) if self.embedder else chunks

    def build(self, files: DataFrame) -> DataFrame:
        """Index (path, text, content_hash) files; returns the status. The metadata row is
        written last: it is the mark of a complete index."""
        self._state("in_progress")
        try:
            code, docs = self._chunks(files)
            self.code.write(code)
            self.docs.write(docs)
            self._postings()
            self.prints.write(sources.fingerprints(files))
        except Exception:
            self._state("failed")
            raise
        self._state("complete")
        return self.status()

    def index_vectors(self, corpus: str = "code", partitions: int | None = None) -> dict:
        """Store an inverted file of a corpus's vectors, which searches use until the corpus
        changes; below ten thousand chunks only if ``partitions`` is given. Returns its info."""
        store = self._store(corpus)
        if "vector" in store.read().columns:
            index = vector.InvertedFile.build(store.read().select("id", "vector"), partitions=partitions)
            if index:
                index.write(f"{self.root}/ivf-{corpus}", version=store.version())
        return self.vector_index(corpus)

    def vector_index(self, corpus: str = "code") -> dict:
        index = self._inverted(corpus)
        return index.info() if index else {"has_index": False, "index_type": "none", "chunk_count": self._store(corpus).read().count()}

    def _store(self, corpus: str) -> ChunkStore:
        return self.code if corpus == "code" else self.docs

    def _inverted(self, corpus: str) -> vector.InvertedFile | None:
        """The stored index, unless the corpus has changed since."""
        path = f"{self.root}/ivf-{corpus}"
        fs, p = self.code._fs(f"{path}/centroids/_SUCCESS")
        if not fs.exists(p):
            return None
        index = vector.InvertedFile.read(self.spark, path)
        return index if index.notes.get("version") == self._store(corpus).version() else None

    def _postings(self) -> None:
        for name, store in (("code", self.code), ("docs", self.docs)):
            fts.Index.of(store.read()).write(f"{self.root}/fts-{name}")

    def drift(self, files: DataFrame) -> DataFrame:
        """(status, files): how far ``files`` are from the index."""
        return state.drift(self.prints.read(), sources.fingerprints(files))

    def apply(self, files: DataFrame) -> DataFrame:
        """Bring the index up to ``files``, the whole corpus: (status, files) counts of what
        changed. Chunks of unchanged files are kept with their vectors."""
        delta = state.fingerprint_delta(self.prints.read(), sources.fingerprints(files)).select("path", "status")
        counts = delta.groupBy("status").agg(F.count("*").alias("files")).collect()
        self._apply(delta.where(F.col("status").isin("added", "modified", "removed")), files)
        return self.spark.createDataFrame([tuple(r) for r in counts], "status string, files long")

    reconcile = apply

    def apply_changes(self, changes: DataFrame, load: Callable[[DataFrame], DataFrame]) -> None:
        """Apply (path, op) changes, upsert or delete, such as a stream's batch; ``load``
        gives the files of some paths. A path that cannot be loaded any more is deleted."""
        files = load(changes.where(F.col("op") != "delete").select("path"))
        known = files.select("path", F.lit(True).alias("__there"))
        status = F.when(F.col("__there").isNull(), "removed").otherwise("modified")
        self._apply(changes.select("path").distinct().join(known, "path", "left").select("path", status.alias("status")), files)

    def reindex_file(self, files: DataFrame, path: str) -> None:
        one = self.spark.createDataFrame([(path, "upsert")], "path string, op string")
        self.apply_changes(one, lambda paths: files.join(paths, "path", "left_semi"))

    def _apply(self, delta: DataFrame, files: DataFrame) -> None:
        """Both corpora, comments of code, postings and fingerprints follow one delta; each
        table is a new version, and the fingerprints, which say what is indexed, come last."""
        changed = files.join(delta.where(F.col("status") != "removed").select("path"), "path", "left_semi")
        code, docs = self._chunks(changed)
        gone = delta.select("path")
        self.code.replace_paths(gone, code)
        self.docs.replace_paths(gone.union(gone.select(F.concat(F.lit("[code-comment] "), "path"))), docs)
        self._postings()
        self.prints.replace_paths(gone, sources.fingerprints(changed))
        self._state("complete")

    def rebuild(self, files: DataFrame) -> DataFrame:
        self.drop()
        return self.build(files)

    def drop(self) -> None:
        """Chunks, postings, fingerprints and metadata go: the status is not_found."""
        fs, p = self.code._fs(self.root)
        fs.delete(p, True)

    # searching

    def _check(self, query: str, top_k: int) -> None:
        if not 1 <= len(query) <= MAX_QUERY:
            raise ValueError(f"a query has 1 to {MAX_QUERY} characters")
        if not 1 <= top_k <= MAX_TOP_K:
            raise ValueError(f"top_k is 1 to {MAX_TOP_K}")

    def search(self, query: str, top_k: int = 10, mode: str = "hybrid", alpha: float | None = None, corpus: str = "code", compact: bool = False) -> DataFrame:
        """Chunks for a query, merged by file, best first. The expanded query is embedded,
        keywords get the original. Without an embedder: keywords alone."""
        self._check(query, top_k)
        mode, alpha = fusion.mode_of(mode), fusion.alpha_of(alpha, self.config.default_alpha)
        chunks = self._store(corpus).read()
        meta = self.metadata().first()
        if meta and meta["model"] != self.model:
            raise ValueError(f"the index was built with model {meta['model']!r}, not {self.model!r}: rebuild it")
        if self.embed_query is None:
            mode = "fts"
        scorer = fts.scorer_for(meta["files"] if meta else 0, {"tfidf": "js", "bm25": "native"}.get(self.config.scorer, "auto"))
        n = top_k if mode != "hybrid" else fusion.overfetch(top_k)
        index = fts.Index.read(self.spark, f"{self.root}/fts-{corpus}")
        by_words = fts.search(chunks, query, n, scorer, index) if mode != "vector" else None
        by_vector = None
        if mode != "fts":
            q = self.embed_query(expand(query).expanded)
            vector.check_dimension(chunks, q)
            index_of = self._inverted(corpus)
            by_vector = fts.ranked((index_of.search(q, n) if index_of else vector.top_k(chunks, q, n)).select("id", "score"), n)
        found = by_words if mode == "fts" else by_vector if mode == "vector" else fusion.fuse(by_vector, by_words, top_k, alpha)
        rows = chunks.join(found.select("id", "score"), "id").select("id", "path", "text", "start_line", "end_line", "score")
        out = results.processed(rows)
        return results.compact(out) if compact else out

    def search_docs(self, query: str, top_k: int = 10, mode: str = "vector", **kw) -> DataFrame:
        return self.search(query, top_k, mode, corpus="docs", **kw)

    def paths(self, pattern: str, limit: int = 20) -> DataFrame:
        if not 1 <= limit <= 100:
            raise ValueError("limit is 1 to 100")
        return paths.by_glob(self.prints.read(), pattern, limit)

    def summary(self, files: DataFrame) -> DataFrame:
        return chunking.summarized(files)

    # state

    _META = "state string, model string, files long, chunks long, doc_chunks long, strategy string, chunking string, updated timestamp"

    def _state(self, name: str) -> None:
        files = self.prints.read().count() if name == "complete" else 0
        code, docs = (s.read().count() if name == "complete" else 0 for s in (self.code, self.docs))
        row = self.spark.createDataFrame([(name, self.model, files, code, docs, self.config.indexing_strategy, self.config.chunking_strategy)], self._META.rsplit(",", 1)[0])
        write_json(row.withColumn("updated", F.current_timestamp()), f"{self.root}/metadata")

    def metadata(self) -> DataFrame:
        return read_json(self.spark, f"{self.root}/metadata", self._META)

    def status(self) -> DataFrame:
        """One row: ready, indexing, failed or not_found, with counts."""
        fs, p = self.code._fs(f"{self.root}/metadata")
        if not fs.exists(p):
            return self.spark.createDataFrame([("not_found",)], "status string")
        known = F.create_map(*[F.lit(x) for x in ("complete", "ready", "in_progress", "indexing")])
        return self.metadata().withColumn("status", F.coalesce(known[F.col("state")], F.lit("failed")))

    def options(self) -> dict:
        return asdict(self.config)
