"""Transformer models in ONNX files as token encoders, run by onnxruntime in the Python workers."""

from __future__ import annotations

import numpy as np

#: Devices in order of preference and what runs them.
PROVIDERS = {"cuda": "CUDAExecutionProvider", "mps": "CoreMLExecutionProvider", "cpu": "CPUExecutionProvider"}
DTYPES = {"float32": np.float32, "float16": np.float16, "float64": np.float64}
_sessions: dict[tuple, object] = {}


def _runtime():
    try:
        import onnxruntime
    except ImportError as e:
        raise ImportError("this encoder needs the package onnxruntime; install it on driver and executors") from e
    return onnxruntime


def get_device(device: str | None = None, have: list[str] | None = None) -> str:
    """The device asked for, which must be there, or the best there is."""
    have = _runtime().get_available_providers() if have is None else have
    if device is None:
        return next(d for d, p in PROVIDERS.items() if p in have or d == "cpu")
    if device not in PROVIDERS:
        raise ValueError(f"Invalid device: {device!r}; one of {', '.join(PROVIDERS)}")
    if PROVIDERS[device] not in have:
        raise ValueError(f"device {device!r} isn't available here")
    return device


class OnnxEncoder:
    """A model with inputs ``input_ids`` and, if it has them, ``attention_mask`` and ``token_type_ids`` and a first output
    of (n, width, dim) token vectors.

    The file is read where this is made and goes to tasks as it is; a worker makes one session of it, with ``threads`` threads (1,
    for Spark gives every core a task of its own) and ``optimize`` as onnxruntime's graph optimisation.  ``dtype`` is the precision that vectors leave in.
    """

    def __init__(self, path: str, device: str | None = None, dtype: str = "float32", max_length: int | None = 512, threads: int = 1, optimize: bool = True):
        if dtype not in DTYPES:
            raise ValueError(f"Invalid dtype: {dtype!r}; one of {', '.join(DTYPES)}")
        with open(path, "rb") as f:
            self.model = f.read()
        self.device, self.dtype, self.max_length, self.threads, self.optimize = get_device(device), dtype, max_length, threads, optimize
        shape = self._session().get_outputs()[0].shape
        if len(shape) != 3 or not isinstance(shape[2], int):
            raise ValueError(f"the model's first output has the shape {shape}, not tokens' vectors of a known size")
        self.dim = shape[2]

    def _session(self):
        key = (hash(self.model), self.device, self.threads, self.optimize)
        if key not in _sessions:
            rt = _runtime()
            options = rt.SessionOptions()
            options.intra_op_num_threads = self.threads
            options.graph_optimization_level = rt.GraphOptimizationLevel.ORT_ENABLE_ALL if self.optimize else rt.GraphOptimizationLevel.ORT_DISABLE_ALL
            _sessions[key] = rt.InferenceSession(self.model, options, providers=[PROVIDERS[self.device]])
        return _sessions[key]

    def to(self, device: str) -> OnnxEncoder:
        """The same model on another device."""
        out = object.__new__(OnnxEncoder)
        out.__dict__ = self.__dict__ | {"device": get_device(device)}
        return out

    def half(self) -> OnnxEncoder:
        out = object.__new__(OnnxEncoder)
        out.__dict__ = self.__dict__ | {"dtype": "float16"}
        return out

    def encode(self, input_ids: np.ndarray, attention_mask: np.ndarray, special_tokens_mask: np.ndarray) -> tuple[np.ndarray, None]:
        session = self._session()
        given = {"input_ids": input_ids.astype(np.int64), "attention_mask": attention_mask.astype(np.int64), "token_type_ids": np.zeros(input_ids.shape, dtype=np.int64)}
        wanted = {i.name for i in session.get_inputs()}
        (out, *_) = session.run(None, {k: v for k, v in given.items() if k in wanted})
        return out.astype(DTYPES[self.dtype]), None
