"""Status codes as exceptions."""


class KVError(Exception):
    """Base of all errors of the engine."""


class NotFound(KVError): ...


class Corruption(KVError): ...


class NotSupported(KVError): ...


class InvalidArgument(KVError): ...


class IOFailure(KVError): ...


class Busy(KVError): ...


class Aborted(KVError): ...


class TimedOut(KVError): ...


class ReadOnly(KVError): ...


class MergeOperatorNotConfigured(KVError): ...


class ColumnFamilyExists(KVError): ...


class ColumnFamilyNotFound(KVError): ...


class CannotDropDefault(KVError): ...


class Sealed(KVError): ...
