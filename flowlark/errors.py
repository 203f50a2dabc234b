"""What can go wrong, by the part of the engine in which it does."""


class CaptureError(RuntimeError):
    """A capture that cannot be read; operating system errors are wrapped in it."""


class PacketAnalysisError(RuntimeError):
    """Decoding failed in a way that is no property of a packet."""


class FlowError(ValueError):
    """Packets out of order or of no flow."""


class DetectionError(ValueError):
    """Settings, findings or expectations that detectors and their evaluation cannot use."""
