"""Settings that change results or bound memory; always passed explicitly."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class EngineConfig:
    # Chunk windows, in tokens.
    chunk_size: int = 512
    chunk_overlap: int = 64

    # Retrieval.
    top_k: int = 6
    min_score: float = 0.25
    pool_size: int = 30
    rerank: bool = True

    # Intake.
    max_upload_mb: int = 50
    allowed_mime_types: str = "application/pdf,image/jpeg,image/jpg,image/png"
    storage_root: str = "/data/storage"

    # Models.
    embedding_dim: int = 1536
    embed_batch: int = 64
    rerank_batch: int = 32
    rerank_max_tokens: int = 512

    # A table is broadcast only when its measured size is at most this.
    broadcast_bytes: int = 64 * 1024 * 1024
    # Vector bytes of the chunks that a task scores at once when questions are too many to broadcast.
    chunk_block_bytes: int = 256 * 1024 * 1024

    # Tasks of a search scan; None keeps one per split of the chunk table.
    scan_tasks: int | None = None
    # Parts in which a question's rows from all tasks are cut before they meet.
    merge_parts: int = 32

    def __post_init__(self) -> None:
        if self.chunk_size < 1:
            raise ValueError("chunk_size must be at least 1")
        if not 0 <= self.chunk_overlap < self.chunk_size:
            raise ValueError("chunk_overlap must be in [0, chunk_size): the window would not advance")
        if not 1 <= self.top_k <= 50:
            raise ValueError("top_k must be in 1..50")
        if self.pool_size < 1 or self.embed_batch < 1 or self.rerank_batch < 1 or self.rerank_max_tokens < 1 or self.merge_parts < 1:
            raise ValueError("pool_size, batch sizes, token limits and merge_parts must be at least 1")
        if not -1.0 <= self.min_score <= 1.0:
            raise ValueError("min_score is a cosine and must be in [-1, 1]")

    @property
    def stride(self) -> int:
        return self.chunk_size - self.chunk_overlap

    @property
    def max_upload_bytes(self) -> int:
        return self.max_upload_mb * 1024 * 1024

    @property
    def allowed_mimes(self) -> list[str]:
        parts = (p.strip().lower() for p in self.allowed_mime_types.split(","))
        return sorted({p for p in parts if p})
