"""Formats: importing the modules registers their readers."""

from gneiss.formats import lzo, qnx, readers, sevenzip, squashfs, ubifs, yaffs

__all__ = ["lzo", "qnx", "readers", "sevenzip", "squashfs", "ubifs", "yaffs"]
