"""All settings of the engine, with the defaults that results depend on."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field, fields, replace

#: Fixed text of the default prompt.
SYSTEM_PROMPT = (
    "You are a helpful question-answering assistant.\n\n"
    "Answer the user's question using ONLY the information in the context "
    "provided below.\n"
    "Follow these rules strictly:\n"
    "- Write a clear, complete answer in your own words — do NOT copy landing_zone "
    "text from the context\n"
    "- Use 2-3 sentences unless the answer is a simple fact\n"
    "- If the answer requires explaining a reason or motivation, explain it fully\n"
    "- Cite which source number(s) support your answer at the end, like: [1] or [1, 3]\n"
    '- If the answer is not in the context, say: "I don\'t have enough information to answer that."\n'
    "- Never make up facts not present in the context"
)
PROMPT_TEMPLATE = "{system}\n\nContext:\n{context}\n\nQuestion: {question}\n\nAnswer:"
NO_CONTEXT = "No context available."

#: Names of the settings that can be given as environment-style variables.
VARIABLES = {
    "chunk_size": "CHUNK_SIZE",
    "chunk_overlap": "CHUNK_OVERLAP",
    "similarity_threshold": "SEMANTIC_SIMILARITY_THRESHOLD",
    "min_sentences": "SEMANTIC_MIN_SENTENCES",
    "max_sentences": "SEMANTIC_MAX_SENTENCES",
    "top_k": "RETRIEVAL_TOP_K",
    "max_context_chars": "MAX_CONTEXT_CHARS",
    "upsert_batch": "UPSERT_BATCH_SIZE",
    "embed_batch": "EMBED_BATCH_SIZE",
    "embed_retries": "EMBED_RETRIES",
    "docx_page_chars": "DOCX_PSEUDO_PAGE_CHARS",
    "dimension": "OLLAMA_EMBED_DIMENSION",
    "pii_enabled": "PII_ENABLED",
    "pii_types": "PII_ENABLED_TYPES",
    "store_enabled": "RELATIONAL_STORE_ENABLED",
    "ocr_language": "TESSERACT_LANG",
    "score_scale": "VECTOR_STORE_TYPE",
}


@dataclass(frozen=True)
class EngineConfig:
    """``score_scale``: ``pinecone`` and ``qdrant`` score by the cosine, ``chroma`` by ``max(0, (1 + cosine) / 2)``."""

    chunk_size: int = 512
    chunk_overlap: int = 64
    similarity_threshold: float = 0.75
    min_sentences: int = 2
    max_sentences: int = 15
    top_k: int = 5
    max_context_chars: int = 6000
    upsert_batch: int = 100
    embed_batch: int = 8
    embed_retries: int = 3
    docx_page_chars: int = 3000
    dimension: int = 768
    pii_enabled: bool = True
    pii_types: tuple[str, ...] = ()
    store_enabled: bool = True
    ocr_language: str = "eng"
    score_scale: str = "pinecone"
    min_document_chars: int = 20
    nbsp_to_space: bool = False
    nfkc: bool = False
    system_prompt: str = SYSTEM_PROMPT
    prompt_template: str = PROMPT_TEMPLATE
    semantic_types: tuple[str, ...] = field(default=("html", "json"))

    @classmethod
    def from_variables(cls, variables: Mapping[str, str]) -> EngineConfig:
        """Settings from a mapping of variable names. Only ``true`` in any case is true; unknown names are ignored."""
        given = {}
        for f in fields(cls):
            name = VARIABLES.get(f.name)
            if name is None or name not in variables:
                continue
            raw = variables[name]
            if isinstance(f.default, bool):
                given[f.name] = raw.strip().lower() == "true"
            elif isinstance(f.default, int):
                given[f.name] = int(raw)
            elif isinstance(f.default, float):
                given[f.name] = float(raw)
            elif isinstance(f.default, tuple):
                given[f.name] = tuple(x.strip() for x in raw.split(",") if x.strip())
            else:
                given[f.name] = raw.strip()
        config = cls(**given)
        if config.score_scale.lower() not in ("pinecone", "chroma", "qdrant"):
            raise ValueError(f"unknown vector store type: {config.score_scale}")
        return replace(config, score_scale=config.score_scale.lower())
