"""Media columns: 8-bit audio, polyphase resampling, log-mel filterbanks, hysteresis energy segments.

A media column holds WAV files of mono 8-bit samples. Features are computed from the samples that a file
gives back: brought to another rate by the phases of a low-pass filter, cut in overlapping frames, the last filled
up with zeros, put through a mel filterbank. Where a frame's energy rises above one threshold a segment begins, and
where it falls below a lower one it ends. Each segment is pooled to a tensor of one shape, FRAMES by MELS. The tensors
are stored in Arrow files as a column of fixed-shape tensors beside the documents' ids and the segments' time spans.
A file is gone through in groups of frames, so its length doesn't matter.
"""

from __future__ import annotations

import hashlib
import math
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from vecloom.llm.common import keyed, open_folder, row_key, settle, shared_dir, strings

RATE, TARGET, UNIT = 16_000, 8_000, 192
TAPS, WINDOW, HOP, FFT, MELS, FRAMES, GROUP, FLUSH = 8, 200, 80, 256, 16, 8, 1024, 4096
RISE, FALL = 0.5, -0.25
TENSOR = pa.fixed_shape_tensor(pa.float16(), [FRAMES, MELS])
STORED = pa.schema([("doc_id", pa.int64()), ("key", pa.int64()), ("segment", pa.int32()), ("begin_s", pa.float64()), ("end_s", pa.float64()), ("tensor", TENSOR)])


def to_wav(payload: bytes) -> bytes:
    """A WAV file whose samples are these bytes; its length must be even."""
    n = len(payload)
    return struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", 36 + n, b"WAVE", b"fmt ", 16, 1, 1, RATE, RATE, 1, 8, b"data", n) + payload


def from_wav(data: bytes) -> bytes:
    """The samples of the first data chunk of a mono 8-bit file."""
    if data[:4] != b"RIFF" or data[8:12] != b"WAVE":
        raise ValueError("not a WAV file")
    at = 12
    while at + 8 <= len(data):
        name, n = struct.unpack_from("<4sI", data, at)
        if name == b"fmt " and struct.unpack_from("<HHIIHH", data, at + 8)[::5] != (1, 8):
            raise ValueError("not 8-bit samples")
        if name == b"data":
            return data[at + 8 : at + 8 + n]
        at += 8 + n + n % 2
    raise ValueError("no samples")


class Resampler:
    """Any rational change of rate by the phases of one filter, a windowed sinc at the lower of both bands."""

    def __init__(self, rate: int, target: int):
        g = math.gcd(rate, target)
        self.up, self.down = target // g, rate // g
        self.each = TAPS * max(1, -(-self.down // self.up))  # taps of a phase
        n = self.each * self.up
        t = np.arange(n) - (n - 1) / 2
        h = np.sinc(t / max(self.up, self.down)) * np.hamming(n)
        self.filter, self.shift = (h / h.sum() * self.up).astype(np.float32), n // 2 - 1

    def size(self, n: int) -> int:
        """How many samples n become."""
        return -(-n * self.up // self.down)

    def run(self, samples: np.ndarray, begin: int, end: int) -> np.ndarray:
        """Samples begin to end of the result; there is silence (128) before and after the samples."""
        first, last = (begin * self.down + self.shift) // self.up - self.each + 1, ((end - 1) * self.down + self.shift) // self.up + 1
        inside = samples[max(0, first) : max(0, min(last, len(samples)))].astype(np.float32)
        x = np.zeros(last - first, np.float32)
        x[max(0, -first) : max(0, -first) + len(inside)] = (inside - 128) / 128
        out = np.zeros(end - begin, np.float32)
        for n in range(begin, min(end, begin + self.up)):  # the outputs of one phase
            at, phase = divmod(n * self.down + self.shift, self.up)
            mine = out[n - begin :: self.up]
            for j in range(self.each):
                mine += self.filter[phase + j * self.up] * x[at - j - first :: self.down][: len(mine)]
        return out


def mel_bank(rate: float) -> np.ndarray:
    """Triangles evenly spaced in mel, FFT bins by MELS."""
    top = 2595 * np.log10(1 + rate / 2 / 700)
    edge = 700 * (10 ** (np.linspace(0, top, MELS + 2) / 2595) - 1)
    f = np.fft.rfftfreq(FFT, 1 / rate)[:, None]
    up, down = (f - edge[:-2]) / (edge[1:-1] - edge[:-2]), (edge[2:] - f) / (edge[2:] - edge[1:-1])
    return np.maximum(0, np.minimum(up, down)).astype(np.float32)


RESAMPLER, BANK, HANN = Resampler(RATE, TARGET), mel_bank(TARGET), np.hanning(WINDOW).astype(np.float32)


def log_mel(samples: bytes, resampler: Resampler = RESAMPLER, bank: np.ndarray = BANK) -> tuple[np.ndarray, np.ndarray]:
    """Of each frame the log-mel values and the energy in decibels. The frames cover all samples."""
    data = np.frombuffer(samples, np.uint8)
    size = resampler.size(len(data))
    n = max(0, -(-(size - WINDOW) // HOP)) + 1
    mel, energy = [], []
    for i in range(0, n, GROUP):
        j = min(n, i + GROUP)
        x = np.zeros((j - i - 1) * HOP + WINDOW, np.float32)
        end = min(size, i * HOP + len(x))
        x[: end - i * HOP] = resampler.run(data, i * HOP, end)
        f = np.lib.stride_tricks.sliding_window_view(x, WINDOW)[::HOP]
        f = (f - f.mean(axis=1, keepdims=True)) * HANN
        spectrum = np.fft.rfft(f, FFT)
        mel.append(np.log((spectrum.real**2 + spectrum.imag**2).astype(np.float32) @ bank + np.float32(1e-6)))
        energy.append(10 * np.log10((f * f).mean(axis=1) + 1e-10))
    return np.concatenate(mel), np.concatenate(energy)


def segments(energy: np.ndarray) -> np.ndarray:
    """First frame and end of each segment; thresholds are RISE and FALL standard deviations from the mean."""
    level, spread = energy.mean(), energy.std()
    mark = np.where(energy > level + RISE * spread, 1, np.where(energy < level + FALL * spread, -1, 0))
    last = np.maximum.accumulate(np.where(mark != 0, np.arange(len(mark)), -1))
    on = (last >= 0) & (mark[last] > 0)
    return np.flatnonzero(np.diff(on.view(np.int8), prepend=0, append=0)).reshape(-1, 2)


def tensors(mel: np.ndarray, spans: np.ndarray) -> np.ndarray:
    """Each segment's frames averaged in FRAMES parts; a shorter segment repeats frames."""
    total = np.concatenate([np.zeros((1, MELS)), np.cumsum(mel, axis=0, dtype=np.float64)])
    cut = spans[:, :1] + (spans[:, 1:] - spans[:, :1]) * np.arange(FRAMES + 1) // FRAMES
    begin, end = cut[:, :-1], np.maximum(cut[:, 1:], cut[:, :-1] + 1)
    return ((total[end] - total[begin]) / (end - begin)[..., None]).astype(np.float32)


MEDIA = "doc_id long, key long, n_bytes long, media binary"
FEATURES = (
    "doc_id long, key long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, "
    "spans array<struct<begin_s: double, end_s: double>>, tensor_file string, tensor_row long"
)


def encode_media(docs: DataFrame) -> DataFrame:
    """doc_id, key, n_bytes and media of each row: the text's bytes, filled up with spaces to a positive multiple of UNIT, as a WAV file. Null is empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, at = strings(b.column(2))
            media = []
            for i, j in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
                text = data[i:j].tobytes()
                media.append(to_wav(text.ljust(max(UNIT, -(-len(text) // UNIT) * UNIT), b" ")))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(np.diff(at)), pa.array(media, pa.binary())], ["doc_id", "key", "n_bytes", "media"])

    return keyed(docs).select("doc_id", row_key(), "text").mapInArrow(run, MEDIA)


def as_tensors(values: np.ndarray) -> pa.ExtensionArray:
    """Segments' tensors as an Arrow array of fixed-shape tensors."""
    flat = pa.array(values.astype(np.float16).ravel(), pa.float16())
    return pa.ExtensionArray.from_storage(TENSOR, pa.FixedSizeListArray.from_arrays(flat, FRAMES * MELS))


class TensorWriter:
    """A task's Arrow file of tensors, begun with its first segment."""

    def __init__(self, folder: str):
        self.place, self.root = open_folder(folder)
        self.file, self.rows = None, 0

    def write(self, doc_id: int, key: int, spans: list[dict], values: np.ndarray) -> tuple[str | None, int | None]:
        """Where they are: the file and the first row."""
        if not spans:
            return None, None
        if self.file is None:
            self.name = f"tensors-{TaskContext.get().partitionId():06d}-{TaskContext.get().taskAttemptId()}.arrow"
            self.out = self.place.open_output_stream(f"{self.root}/{self.name}", compression=None)
            self.file = pa.ipc.new_file(self.out, STORED, options=pa.ipc.IpcWriteOptions(compression="zstd"))
            self.held, self.size = [], 0
        n, at = len(spans), self.rows
        self.held.append(pa.RecordBatch.from_arrays(
            [pa.array([doc_id] * n, pa.int64()), pa.array([key] * n, pa.int64()), pa.array(range(n), pa.int32()), pa.array([s["begin_s"] for s in spans]), pa.array([s["end_s"] for s in spans]), as_tensors(values)], schema=STORED,
        ))
        self.rows, self.size = self.rows + n, self.size + n
        if self.size >= FLUSH:
            self.flush()
        return self.name, at

    def flush(self) -> None:
        if self.held:
            self.file.write_table(pa.Table.from_batches(self.held).combine_chunks())
        self.held, self.size = [], 0

    def close(self) -> None:
        if self.file is not None:
            self.flush()
            self.file.close()
            self.out.close()


def read_tensors(folder: str, name: str) -> pa.Table:
    """A file of tensors: doc_id, key, segment, begin_s, end_s, tensor."""
    place, root = open_folder(folder)
    with place.open_input_file(f"{root}/{name}") as f:
        return pa.ipc.open_file(f).read_all()


def features(media: DataFrame, folder: str | None = None) -> DataFrame:
    """Of each stored file its hashes, a summary of its features, its segments' spans, and where in the folder their tensors are.

    tensor_file and tensor_row: the Arrow file and its row where the segments begin; null without segments or
    without a folder. A task that runs again writes a file of another name; only files that a row names count. A file
    shorter than a frame has one frame; equal files have equal values.
    """
    if folder:
        place, root = open_folder(folder)
        place.create_dir(root, recursive=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        writer = TensorWriter(folder) if folder else None
        for b in batches:
            out: dict[str, list] = {n: [] for n in ("payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "spans", "tensor_file", "tensor_row")}
            for doc_id, key, value in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(3), strict=True):
                data = value.as_py()
                samples = from_wav(data)
                mel, energy = log_mel(samples)
                found = segments(energy)
                tensor = tensors(mel, found)
                mean = " ".join(f"{x:.2f}" for x in mel.mean(axis=0, dtype=np.float64)[:4])
                digest = zlib.crc32(np.round(tensor * 64).astype("<i2").tobytes())
                spans = [{"begin_s": i * HOP / TARGET, "end_s": ((j - 1) * HOP + WINDOW) / TARGET} for i, j in found.tolist()]
                row = (
                    len(samples), hashlib.sha256(samples).hexdigest(), zlib.crc32(samples[-16:]), len(data), hashlib.sha256(data).hexdigest(),
                    f"{len(mel)} frames, {len(found)} segments of {int((found[:, 1] - found[:, 0]).sum())}, mel {mean}, tensors {digest:08x}",
                    spans, *(writer.write(doc_id, key, spans, tensor) if writer else (None, None)),
                )
                for x, y in zip(out.values(), row, strict=True):
                    x.append(y)
            kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.list_(pa.struct([("begin_s", pa.float64()), ("end_s", pa.float64())])), pa.string(), pa.int64()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), *(pa.array(x, t) for x, t in zip(out.values(), kinds, strict=True))], ["doc_id", "key", "n_bytes", *out])
        if writer:
            writer.close()

    return media.select("doc_id", "key", "n_bytes", "media").mapInArrow(run, FEATURES)


def media_features(docs: DataFrame, folder: str | None = None) -> DataFrame:
    """Store the media column in the shared folder, read it back, compute features, store the tensors in a folder (a new one there)."""
    return features(settle(encode_media(docs)), folder or shared_dir(docs.sparkSession))
