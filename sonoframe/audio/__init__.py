"""Audio as arrays of samples: decoding, frames, speech spans, segments, quality. Pure functions on numpy arrays."""
