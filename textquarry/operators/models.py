"""Encoder and generator of pretrained models, where their libraries are installed.

A model is loaded once for each Python worker, the first time it is used.
"""

from __future__ import annotations

import numpy as np

from .answering import MAX_NEW_TOKENS, ExtractiveGenerator
from .dense import HashEncoder

_loaded: dict[tuple[str, str], object] = {}


def _once(kind: str, name: str, load):
    if (kind, name) not in _loaded:
        _loaded[kind, name] = load(name)
    return _loaded[kind, name]


class SentenceEncoder:
    """Unit vectors of a ``sentence_transformers`` model."""

    def __init__(self, model: str, dim: int):
        self.model, self.dim = model, dim

    def encode(self, texts: list[str]) -> np.ndarray:
        try:
            from sentence_transformers import SentenceTransformer
        except ImportError as e:
            raise RuntimeError("sentence_transformers isn't installed; HashEncoder needs no model") from e
        return _once("encoder", self.model, SentenceTransformer).encode(texts, normalize_embeddings=True, show_progress_bar=False)


class ChatGenerator:
    """Greedy answers of a ``transformers`` chat model, without its thinking."""

    def __init__(self, model: str, max_new_tokens: int = MAX_NEW_TOKENS):
        self.model, self.max_new_tokens = model, max_new_tokens

    def generate(self, prompt: str) -> str:
        try:
            from transformers import AutoModelForCausalLM, AutoTokenizer
        except ImportError as e:
            raise RuntimeError("transformers isn't installed; ExtractiveGenerator needs no model") from e
        tokenizer = _once("tokenizer", self.model, AutoTokenizer.from_pretrained)
        model = _once("generator", self.model, AutoModelForCausalLM.from_pretrained)
        chat = [{"role": "user", "content": prompt}]
        text = tokenizer.apply_chat_template(chat, tokenize=False, add_generation_prompt=True, enable_thinking=False)
        given = tokenizer([text], return_tensors="pt")
        made = model.generate(**given, max_new_tokens=self.max_new_tokens, do_sample=False)
        return tokenizer.decode(made[0][given["input_ids"].shape[1] :], skip_special_tokens=True).strip()


def make_encoder(spec: str | None):
    """``hash`` or ``hash:DIM`` (the default, no model), or ``sentence:MODEL:DIM``."""
    kind, _, rest = (spec or "hash").partition(":")
    if kind == "hash":
        return HashEncoder(int(rest)) if rest else HashEncoder()
    name, _, dim = rest.rpartition(":")
    if kind != "sentence" or not name or not dim.isdigit():
        raise ValueError(f"encoder must be hash, hash:DIM or sentence:MODEL:DIM, not {spec}")
    return SentenceEncoder(name, int(dim))


def make_generator(spec: str | None, max_new_tokens: int = MAX_NEW_TOKENS):
    """``extract`` (the default, no model), or ``chat:MODEL``."""
    kind, _, name = (spec or "extract").partition(":")
    if kind == "extract":
        return ExtractiveGenerator()
    if kind != "chat" or not name:
        raise ValueError(f"generator must be extract or chat:MODEL, not {spec}")
    return ChatGenerator(name, max_new_tokens)
