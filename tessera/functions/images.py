"""Descriptors of pixel arrays (numpy; for pandas or Arrow functions), and the decisions around them."""

from __future__ import annotations

import numpy as np

GLCM_DISTANCES, GLCM_LEVELS = (1, 3), 32
GLCM_ANGLES = ((0, 1), (-1, 1), (-1, 0), (-1, -1))  # 0, 45, 90, 135 degrees as (row, column) steps
LBP_POINTS, LBP_RADIUS = 16, 2
HOG_ORIENTATIONS, HOG_CELL, HOG_BLOCK = 9, 32, 2


def gray(rgb: np.ndarray) -> np.ndarray:
    return rgb[..., :3].astype(float) @ np.array([0.299, 0.587, 0.114])


def glcm(image: np.ndarray) -> np.ndarray:
    """12 numbers: contrast, dissimilarity, homogeneity, ASM, energy, correlation, each for both distances, angles averaged."""
    q = np.clip((image / 256.0 * GLCM_LEVELS).astype(int), 0, GLCM_LEVELS - 1)
    h, w = q.shape
    i, j = np.meshgrid(np.arange(GLCM_LEVELS), np.arange(GLCM_LEVELS), indexing="ij")
    out = np.zeros((6, len(GLCM_DISTANCES)))
    for d, distance in enumerate(GLCM_DISTANCES):
        for dy, dx in GLCM_ANGLES:
            y, x = dy * distance, dx * distance
            a = q[max(0, -y) : h - max(0, y), max(0, -x) : w - max(0, x)]
            b = q[max(0, y) : h + min(0, y), max(0, x) : w + min(0, x)]
            m = np.zeros((GLCM_LEVELS, GLCM_LEVELS))
            np.add.at(m, (a.ravel(), b.ravel()), 1)
            m = m + m.T
            m /= max(m.sum(), 1)
            mi, mj = (i * m).sum(), (j * m).sum()
            si, sj = np.sqrt((m * (i - mi) ** 2).sum()), np.sqrt((m * (j - mj) ** 2).sum())
            asm = (m * m).sum()
            correlation = (m * (i - mi) * (j - mj)).sum() / (si * sj) if si > 1e-15 and sj > 1e-15 else 1.0
            out[:, d] += [(m * (i - j) ** 2).sum(), (m * abs(i - j)).sum(), (m / (1 + (i - j) ** 2)).sum(), asm, np.sqrt(asm), correlation]
    return (out / len(GLCM_ANGLES)).ravel()


def lbp(image: np.ndarray) -> np.ndarray:
    """Density histogram (18) of uniform local binary patterns."""
    h, w = image.shape
    r = LBP_RADIUS
    centre = image[r : h - r, r : w - r].astype(float)
    bits = []
    for k in range(LBP_POINTS):
        a = 2 * np.pi * k / LBP_POINTS
        y, x = -round(r * np.sin(a), 5), round(r * np.cos(a), 5)
        y0, x0 = int(np.floor(y)), int(np.floor(x))
        fy, fx = y - y0, x - x0
        at = lambda dy, dx: image[r + dy : h - r + dy, r + dx : w - r + dx] if r + dy >= 0 and h - r + dy <= h and r + dx >= 0 and w - r + dx <= w else np.roll(image, (-dy, -dx), (0, 1))[r : h - r, r : w - r]
        v = (1 - fy) * (1 - fx) * at(y0, x0) + (fy * (1 - fx) * at(y0 + 1, x0) if fy else 0) + ((1 - fy) * fx * at(y0, x0 + 1) if fx else 0) + (fy * fx * at(y0 + 1, x0 + 1) if fy and fx else 0)
        bits.append(v >= centre - 1e-9)
    b = np.array(bits)
    changes = (b != np.roll(b, 1, 0)).sum(0)
    code = np.where(changes <= 2, b.sum(0), LBP_POINTS + 1)
    return np.bincount(code.ravel(), minlength=LBP_POINTS + 2) / max(code.size, 1)


def hog(image: np.ndarray) -> np.ndarray:
    """Histograms of gradient orientations over cells, in overlapping blocks normalised with clipping (L2-Hys)."""
    image = image.astype(float)
    gy, gx = np.zeros_like(image), np.zeros_like(image)
    gy[1:-1], gx[:, 1:-1] = image[2:] - image[:-2], image[:, 2:] - image[:, :-2]
    size, angle = np.hypot(gx, gy), np.rad2deg(np.arctan2(gy, gx)) % 180
    rows, cols = image.shape[0] // HOG_CELL, image.shape[1] // HOG_CELL
    index = np.minimum((angle / (180 / HOG_ORIENTATIONS)).astype(int), HOG_ORIENTATIONS - 1)
    cells = np.zeros((rows, cols, HOG_ORIENTATIONS))
    for r in range(rows):
        for c in range(cols):
            at = np.s_[r * HOG_CELL : (r + 1) * HOG_CELL, c * HOG_CELL : (c + 1) * HOG_CELL]
            cells[r, c] = np.bincount(index[at].ravel(), size[at].ravel(), HOG_ORIENTATIONS) / HOG_CELL**2
    out = []
    for r in range(rows - HOG_BLOCK + 1):
        for c in range(cols - HOG_BLOCK + 1):
            v = cells[r : r + HOG_BLOCK, c : c + HOG_BLOCK].ravel()
            v = np.minimum(v / np.sqrt((v * v).sum() + 1e-10), 0.2)
            out.append(v / np.sqrt((v * v).sum() + 1e-10))
    return np.concatenate(out) if out else np.zeros(0)


def lab_stats(rgb: np.ndarray) -> np.ndarray:
    """L mean, L std, a mean, a std, b mean, b std of CIE Lab (D65)."""
    c = rgb[..., :3].astype(float) / 255
    c = np.where(c > 0.04045, ((c + 0.055) / 1.055) ** 2.4, c / 12.92)
    xyz = c @ np.array([[0.412453, 0.212671, 0.019334], [0.357580, 0.715160, 0.119193], [0.180423, 0.072169, 0.950227]])
    f = xyz / np.array([0.950456, 1.0, 1.088754])
    f = np.where(f > 0.008856, np.cbrt(f), 7.787 * f + 16 / 116)
    lab = np.stack([116 * f[..., 1] - 16, 500 * (f[..., 0] - f[..., 1]), 200 * (f[..., 1] - f[..., 2])], -1)
    flat = lab.reshape(-1, 3)
    return np.stack([flat.mean(0), flat.std(0)], 1).ravel()


def sharpness(image: np.ndarray) -> float:
    """Variance of the Laplacian."""
    i = image.astype(float)
    return float((i[:-2, 1:-1] + i[2:, 1:-1] + i[1:-1, :-2] + i[1:-1, 2:] - 4 * i[1:-1, 1:-1]).var()) if min(i.shape) > 2 else 0.0


def perceptual_hash(image: np.ndarray) -> int:
    """64 bits: low DCT frequencies of a 32 by 32 reduction against their median."""
    h, w = image.shape
    rows = [image[i * h // 32 : max(i * h // 32 + 1, (i + 1) * h // 32)].mean(0) for i in range(32)]
    small = np.array([[r[j * w // 32 : max(j * w // 32 + 1, (j + 1) * w // 32)].mean() for j in range(32)] for r in rows])
    k = np.arange(32)
    dct = np.cos(np.pi * (2 * k[None] + 1) * k[:, None] / 64)
    low = (dct @ small @ dct.T)[:8, :8].ravel()
    return int("".join("1" if x > np.median(low) else "0" for x in low), 2)


def letterbox(width: int, height: int, side: int = 224) -> tuple[int, int, int, int]:
    """New width and height, and left and top padding, of an image fitted into a square."""
    scale = min(side / width, side / height)
    w, h = max(1, round(width * scale)), max(1, round(height * scale))
    return w, h, (side - w) // 2, (side - h) // 2


def preprocessing_steps(hair_coverage: float, contrast_std: float, mode: str = "conditional") -> list[str]:
    """Steps that fire: hair removal from 3 % coverage (not over 30 %), contrast equalisation under a std of 40."""
    if mode == "standard":
        return []
    return ["hair_removal"] * (0.03 <= hair_coverage <= 0.30) + ["clahe"] * (contrast_std < 40.0)


def describe(rgb: np.ndarray) -> dict[str, np.ndarray]:
    g = gray(rgb)
    return {"glcm": glcm(g), "lbp": lbp(g), "hog": hog(g), "color_lab": lab_stats(rgb)}
