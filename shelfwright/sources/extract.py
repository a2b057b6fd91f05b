"""Texts of files: plain text, office documents and PDF; None where there is none to be had."""

from __future__ import annotations

import os
import re
import shutil
import subprocess
import tempfile
import zipfile

from shelfwright.functions.text import TEXT_EXTENSIONS

TEXT_LIMIT = 3_000_000
PDF_PAGES = 5
DOCX_LIMIT = 20_000


def small_text(path: str, limit: int = TEXT_LIMIT) -> str | None:
    """UTF-8 with wrong bytes dropped; none over the limit."""
    try:
        if os.path.getsize(path) > limit:
            return None
        with open(path, "rb") as f:
            return f.read().decode("utf-8", "ignore")
    except OSError:
        return None


def docx_text(path: str) -> str | None:
    """The text of the main part, tags as blanks, white space collapsed."""
    try:
        with zipfile.ZipFile(path) as z:
            xml = z.read("word/document.xml").decode("utf-8", "ignore")
    except (OSError, KeyError, zipfile.BadZipFile, NotImplementedError, RuntimeError):
        return None
    return re.sub(r"\s+", " ", re.sub("<[^>]+>", " ", xml)).strip()[:DOCX_LIMIT]


def pdf_text(path: str, pages: int = PDF_PAGES) -> str | None:
    """The first pages by the tool pdftotext, if it is installed; scratch files stay out of the scanned tree."""
    tool = shutil.which("pdftotext")
    if not tool:
        return None
    with tempfile.TemporaryDirectory() as d:
        out = os.path.join(d, "text")
        try:
            subprocess.run([tool, "-l", str(pages), "-q", path, out], check=True, timeout=120, capture_output=True)
            with open(out, "rb") as f:
                return f.read().decode("utf-8", "ignore")
        except (OSError, subprocess.SubprocessError):
            return None


def text_of(path: str, mime: str | None) -> str | None:
    """By extension or type: plain text first, then PDF, then office documents."""
    ext = os.path.splitext(os.path.basename(path))[1].lower().lstrip(".")
    if ext in TEXT_EXTENSIONS or (mime or "").startswith("text/"):
        return small_text(path)
    if ext == "pdf" or mime == "application/pdf":
        return pdf_text(path)
    if ext == "docx":
        return docx_text(path)
    return None


def luma(path: str) -> list[float] | None:
    """1024 luma values of an image scaled to 32 x 32; none without an image library, for other extensions or bad files."""
    from shelfwright.functions.text import IMAGE_EXTENSIONS

    if os.path.splitext(path)[1].lower().lstrip(".") not in IMAGE_EXTENSIONS:
        return None
    try:
        from PIL import Image

        with Image.open(path) as im:
            return [float(v) for v in im.convert("L").resize((32, 32), Image.BILINEAR).getdata()]
    except Exception:  # noqa: BLE001 - no library, or whatever it raises for a bad file
        return None
