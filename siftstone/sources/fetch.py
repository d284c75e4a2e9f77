"""Documentation repositories and model files to this machine; what is there already is not fetched again."""

from __future__ import annotations

import os
import shutil
import subprocess
import urllib.request
import uuid

#: Models of the local chat provider: repository, file.  Fixed values.
MODELS = {
    "qwen3b": ("Qwen/Qwen2.5-3B-Instruct-GGUF", "qwen2.5-3b-instruct-q4_k_m.gguf"),
    "qwen1.5b": ("Qwen/Qwen2.5-1.5B-Instruct-GGUF", "qwen2.5-1.5b-instruct-q4_k_m.gguf"),
    "llama3b": ("bartowski/Llama-3.2-3B-Instruct-GGUF", "Llama-3.2-3B-Instruct-Q4_K_M.gguf"),
}
HUB = "https://huggingface.co/{repository}/resolve/main/{file}"


def fetch_repository(url: str, folder: str, parts: tuple[str, ...] = ()) -> bool:
    """A shallow clone of ``url`` in ``folder``, only of the directories ``parts`` if any are named; False if it was there."""
    if os.path.isdir(os.path.join(folder, ".git")):
        return False
    sparse = ["--filter=blob:none", "--sparse"] if parts else []
    subprocess.run(["git", "clone", "--quiet", "--depth", "1", *sparse, url, folder], check=True)
    if parts:
        subprocess.run(["git", "-C", folder, "sparse-checkout", "set", *parts], check=True)
    return True


def fetch_file(url: str, path: str) -> bool:
    """The file at ``url`` as ``path``, which appears when it is whole; False if it was there."""
    if os.path.isfile(path):
        return False
    os.makedirs(os.path.dirname(path) or ".", exist_ok=True)
    aside = f"{path}.{uuid.uuid4().hex}"
    try:
        with urllib.request.urlopen(url) as source, open(aside, "wb") as target:
            shutil.copyfileobj(source, target)
        os.replace(aside, path)
    finally:
        if os.path.exists(aside):
            os.remove(aside)
    return True


def fetch_model(name: str, folder: str = "models", hub: str = HUB) -> str:
    """The path of a model of ``MODELS``, fetched if need be."""
    repository, file = MODELS[name]
    path = os.path.join(folder, file)
    fetch_file(hub.format(repository=repository, file=file), path)
    return path
