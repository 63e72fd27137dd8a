"""Media files: where they are, what they are, and their samples or pixels."""

from __future__ import annotations

import hashlib
import io
import os
import re
import shutil
import struct
import subprocess
import tempfile
from collections.abc import Iterable
from pathlib import Path

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from tessera.errors import EngineError

IMAGES = frozenset("png jpg jpeg bmp gif webp pgm ppm npy".split())
SOUNDS = frozenset("wav mp3 flac ogg m4a aac".split())
ALIASES = {"imagen": "image", "image": "image", "img": "image", "foto": "image", "audio": "audio", "sonido": "audio", "sound": "audio"}
MIME = {"image/png", "image/jpeg", "image/bmp", "image/webp", "image/gif", "audio/wav", "audio/x-wav", "audio/mpeg", "audio/flac", "audio/ogg"}


def resolve(name: str, roots: Iterable[str] = (), variable: str = "TESSERA_MEDIA") -> str:
    """The first place that has the file: as named if absolute, then the given roots, the environment's, the working folder."""
    if os.path.isabs(name):
        found = [name]
    else:
        found = [os.path.join(r, name) for r in [*roots, *filter(None, os.environ.get(variable, "").split(os.pathsep)), os.getcwd()]]
    for p in found:
        if os.path.isfile(p):
            return p
    raise EngineError(f"no such file: {name}")


def files(spark: SparkSession, path: str, pattern: str | None = None) -> DataFrame:
    """path, length and content of files in any store."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", True)
    return (reader.option("pathGlobFilter", pattern) if pattern else reader).load(path)


def kind_of(data: bytes, name: str = "", kind: str | None = None) -> str:
    """``image`` or ``audio``: as said, else by extension, else by the first bytes."""
    if kind:
        if kind.lower() not in ALIASES:
            raise EngineError(f"unknown kind of media: {kind}")
        return ALIASES[kind.lower()]
    extension = name.rsplit(".", 1)[-1].lower() if "." in name else ""
    if extension in IMAGES:
        return "image"
    if extension in SOUNDS:
        return "audio"
    if data[:4] == b"RIFF" and data[8:12] == b"WAVE" or data[:3] == b"ID3" or data[:4] in (b"fLaC", b"OggS"):
        return "audio"
    if data[:8] == b"\x89PNG\r\n\x1a\n" or data[:2] in (b"\xff\xd8", b"BM", b"P2", b"P3", b"P5", b"P6") or data[:4] == b"GIF8" or data[:6] == b"\x93NUMPY":
        return "image"
    raise EngineError(f"neither image nor sound: {name}")


def _chunks(data: bytes) -> dict[bytes, bytes]:
    """The first chunk of each name in a RIFF file: after 12 bytes, name, length, and contents filled up to an even length."""
    out: dict[bytes, bytes] = {}
    at = 12
    while at + 8 <= len(data):
        name, size = struct.unpack_from("<4sI", data, at)
        out.setdefault(name, data[at + 8 : at + 8 + size])
        at += 8 + size + size % 2
    return out


def read_wav(data: bytes) -> tuple[np.ndarray, int]:
    """Mono samples in -1..1 and their rate; what is not a RIFF file goes through ffmpeg where that is installed.

    Integers of 8 (unsigned), 16 and 32 bits are read, in any number of channels.
    """
    found = _chunks(data if data.startswith(b"RIFF") else _transcoded(data))
    if len(found.get(b"fmt ", b"")) < 16 or b"data" not in found:
        raise EngineError("not a PCM WAV: no format or no samples")
    code, channels, rate, _, _, bits = struct.unpack_from("<HHIIHH", found[b"fmt "])
    numbers = {8: (np.uint8, 128, 128), 16: ("<i2", 0, 1 << 15), 32: ("<i4", 0, 1 << 31)}
    if code not in (1, 0xFFFE) or not channels:
        raise EngineError("not a PCM WAV: another coding")
    if bits not in numbers:
        raise EngineError(f"{bits} bits per sample are not supported")
    kind, middle, top = numbers[bits]
    frames = len(found[b"data"]) // (bits // 8 * channels)
    if not frames:
        raise EngineError("the sound has no samples")
    mono = np.frombuffer(found[b"data"], kind, frames * channels).reshape(frames, channels).mean(axis=1)
    return (mono - middle) / top, rate


def _transcoded(data: bytes) -> bytes:
    tool = shutil.which("ffmpeg")
    if not tool:
        raise EngineError("only PCM WAV can be read without ffmpeg")
    made = subprocess.run([tool, "-v", "error", "-i", "pipe:0", "-f", "wav", "-acodec", "pcm_s16le", "pipe:1"], input=data, capture_output=True, check=False)
    if made.returncode:
        raise EngineError(f"ffmpeg: {made.stderr.decode(errors='replace')[:200]}")
    return made.stdout


def read_image(data: bytes) -> np.ndarray:
    """Grey values in 0..1 from PGM, PPM or .npy bytes; other formats need Pillow."""
    if data[:6] == b"\x93NUMPY":
        x = np.load(io.BytesIO(data), allow_pickle=False).astype(np.float64)
        x = x if x.ndim == 2 else x[..., :3] @ np.array([0.299, 0.587, 0.114])
        return x / 255 if x.max(initial=0) > 1 else x
    if data[:1] == b"P" and data[1:2] in b"2356":
        return _netpbm(data)
    try:
        from PIL import Image
    except ImportError as e:
        raise EngineError("this image format needs Pillow") from e
    return np.asarray(Image.open(io.BytesIO(data)).convert("L"), np.float64) / 255


def _netpbm(data: bytes) -> np.ndarray:
    head = re.match(rb"P([2356])(?:\s|#[^\n]*\n)+(\d+)(?:\s|#[^\n]*\n)+(\d+)(?:\s|#[^\n]*\n)+(\d+)\s", data)
    if not head:
        raise EngineError("broken PGM or PPM header")
    kind, w, h, top = (int(x) for x in head.groups())
    n = w * h * (3 if kind in (3, 6) else 1)
    body = data[head.end() :]
    try:
        x = np.array(body.split()[:n], float) if kind in (2, 3) else np.frombuffer(body, "u1" if top < 256 else ">u2", n).astype(float)
    except ValueError as e:
        raise EngineError("the image is cut off") from e
    if len(x) < n:
        raise EngineError("the image is cut off")
    x = x.reshape(h, w, -1) / top
    return x[..., 0] if x.shape[2] == 1 else x @ np.array([0.299, 0.587, 0.114])


def save_upload(folder: str, name: str, data: bytes, mime: str | None = None) -> str:
    """Keep an upload under the digest of its content and its own extension, so names never meet and equal files are kept once.

    It is written beside its place and renamed, so a reader never sees half a file.
    """
    if mime is not None and mime.lower() not in MIME:
        raise EngineError(f"files of type {mime} are not accepted")
    extension = os.path.splitext(name)[1].lower().lstrip(".")
    kept = os.path.join(folder, hashlib.blake2b(data, digest_size=20).hexdigest() + (f".{extension}" if extension in IMAGES | SOUNDS else ""))
    if not os.path.exists(kept):
        os.makedirs(folder, exist_ok=True)
        handle, part = tempfile.mkstemp(dir=folder)
        with os.fdopen(handle, "wb") as f:
            f.write(data)
        os.replace(part, kept)
    return kept


def as_features(models: dict, roots: Iterable[str] = ()):
    """A function for the engine that turns a file name into a feature vector."""
    from tessera.operators.media import extract

    def features(name: str, kind: str | None = None) -> list[float]:
        path = resolve(name, roots)
        return extract(Path(path).read_bytes(), models, path, kind)

    return features
