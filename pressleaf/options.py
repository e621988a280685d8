"""What to embed, drop and write; one immutable value that closures carry to the executors."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Options:
    base_url: str | None = None
    blacklist_domains: bool = False
    domains: tuple[str, ...] | None = None
    encoding: str | None = None
    ignore_errors: bool = False
    insecure: bool = False
    isolate: bool = False
    no_audio: bool = False
    no_css: bool = False
    no_fonts: bool = False
    no_frames: bool = False
    no_images: bool = False
    no_js: bool = False
    no_metadata: bool = False
    no_video: bool = False
    output_format: str = "html"
    silent: bool = False
    timeout: int = 0
    unwrap_noscript: bool = False
    user_agent: str | None = None
    # of this engine: depth of imports and frames, and the time that metadata states
    max_depth: int = 8
    timestamp: str = "1970-01-01T00:00:00Z"
