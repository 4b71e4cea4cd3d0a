"""Small helpers on one example's arrays (rows x columns x channels), used inside tasks."""

from __future__ import annotations

import numpy as np


def centred(values: np.ndarray, size: int) -> np.ndarray:
    """Central crop, or zero padding around the centre, to size x size."""
    out = np.zeros((size, size, *values.shape[2:]), values.dtype)
    source, target = [], []
    for have in values.shape[:2]:
        cut, before = max(have - size, 0) // 2, max(size - have, 0) // 2
        source.append(slice(cut, cut + min(have, size)))
        target.append(slice(before, before + min(have, size)))
    out[tuple(target)] = values[tuple(source)]
    return out


def turned(values: np.ndarray, angle: float, nearest: bool = False) -> np.ndarray:
    """Rotated about the centre, zero outside: each target cell reads its place in the source, bilinear or from the nearest cell."""
    height, width = values.shape[:2]
    mi, mj = (height - 1) / 2, (width - 1) / 2
    y, x = np.mgrid[:height, :width].astype(float)
    y, x = y - mi, x - mj
    cos, sin = np.cos(angle), np.sin(angle)
    i, j = mi + y * cos + x * sin, mj - y * sin + x * cos

    def read(at_i: np.ndarray, at_j: np.ndarray) -> np.ndarray:
        inside = (at_i >= 0) & (at_i < height) & (at_j >= 0) & (at_j < width)
        got = values[np.clip(at_i, 0, height - 1), np.clip(at_j, 0, width - 1)]
        return np.where(inside[..., None], got, 0.0)

    if nearest:
        return read(np.rint(i).astype(int), np.rint(j).astype(int))
    fi, fj = np.floor(i).astype(int), np.floor(j).astype(int)
    wi, wj = (i - fi)[..., None], (j - fj)[..., None]
    top = read(fi, fj) * (1 - wj) + read(fi, fj + 1) * wj
    return top * (1 - wi) + (read(fi + 1, fj) * (1 - wj) + read(fi + 1, fj + 1) * wj) * wi


def recoloured(image: np.ndarray, brightness: float, contrast: float, saturation: float) -> np.ndarray:
    """Brightness, contrast about the mean of each band, then saturation with value and hue unchanged (at most full)."""
    image = image + brightness
    mean = image.mean(axis=(0, 1))
    image = (image - mean) * contrast + mean
    top, low = image.max(axis=2, keepdims=True), image.min(axis=2, keepdims=True)
    strength = np.divide(top - low, top, out=np.zeros_like(top), where=top > 0)
    most = np.divide(1.0, strength, out=np.full_like(top, np.inf), where=strength > 0)
    return top - (top - image) * np.minimum(saturation, most)


def parts_of(mask: np.ndarray) -> np.ndarray:
    """Labels of the 4-connected parts of a mask: the smallest position of the part; -1 outside."""
    size = mask.size
    label = np.where(mask, np.arange(size).reshape(mask.shape), size)
    while True:
        wide = np.pad(label, 1, constant_values=size)
        near = np.minimum.reduce([wide[1:-1, 1:-1], wide[:-2, 1:-1], wide[2:, 1:-1], wide[1:-1, :-2], wide[1:-1, 2:]])
        near = np.where(mask, near, size)
        # A label's own label is at least as small: paths shorten by halves.
        near = np.append(near.ravel(), size)[near]
        if (near == label).all():
            return np.where(mask, label, -1)
        label = near


def without_parts(layers: np.ndarray, keep: float, draw: np.random.Generator) -> np.ndarray:
    """Keeps each connected part of the first layer with a probability, and all layers under it, grown by one cell."""
    label = parts_of(layers[..., 0] > 0)
    names = np.unique(label[label >= 0])
    chosen = np.isin(label, names[draw.random(len(names)) < keep])
    wide = np.pad(chosen, 1)
    rows, cols = chosen.shape
    grown = np.logical_or.reduce([wide[a : a + rows, b : b + cols] for a in range(3) for b in range(3)])
    return np.where(grown[..., None], layers, 0.0)
