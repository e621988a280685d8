"""Functions on URLs, media types, texts and style sheets, as plain Python and as columns."""
