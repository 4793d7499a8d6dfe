"""What can go wrong, by who has to act."""


class CorpusError(Exception):
    """Base of all errors raised here."""


class RequestInvalid(CorpusError):
    """A request breaks the contract; the caller has to change it."""


class KnowledgeUnavailable(CorpusError):
    """Index, scores or parents are missing or contradict each other; never answered as an empty result."""


class IndexMissing(KnowledgeUnavailable):
    """No index was written yet; run the ingest first."""


class DocumentInvalid(CorpusError):
    """Source documents break the rules; nothing was written."""
