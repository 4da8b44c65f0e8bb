"""Column names and types of the event and node tables."""

from __future__ import annotations

#: Keys of the record types in the raw lines, in the order in which they are tried.
RECORD_PREFIX = "com.bbn.tc.schema.avro.cdm20."
RECORD_TABLES = {
    "Event": "events",
    "Subject": "subjects",
    "FileObject": "fileobjects",
    "NetFlowObject": "netflows",
    "RegistryKeyObject": "registrykeys",
    "IpcObject": "ipc",
    "MemoryObject": "memory",
}
#: Where an event's time may be; the first that is a number counts.
TIME_KEYS = ("timestampNanos", "tsNanos", "timestamp", "eventTimeNanos", "eventTime", "time")

EVENTS = (
    "uuid string, event_type string, timestampNanos bigint, subject_uuid string, object1_uuid string, object2_uuid string, "
    "size bigint, hostId string, source string, sessionNumber bigint, malicious int"
)
SUBJECTS = (
    "uuid string, subject_type string, cid bigint, parentSubject string, localPrincipal string, startTimestampNanos bigint, "
    "cmdLine string, privilegeLevel string, hostId string, source string, sessionNumber bigint"
)
FILEOBJECTS = "uuid string, file_type string, fileDescriptor string, size bigint, hostId string, source string, sessionNumber bigint"
NETFLOWS = (
    "uuid string, localAddress string, localPort int, remoteAddress string, remotePort int, ipProtocol int, fileDescriptor string, "
    "hostId string, source string, sessionNumber bigint"
)
REGISTRYKEYS = "uuid string, key string, hostId string, source string, sessionNumber bigint"
IPC = "uuid string, ipc_type string, fd1 bigint, fd2 bigint, hostId string, source string, sessionNumber bigint"
MEMORY = "uuid string, memoryAddress bigint, size bigint, hostId string, source string, sessionNumber bigint"

#: Column names that a table may use for time and host, best first.
TIME_COLUMNS = ("timestampNanos", "tsNanos", "timestamp", "eventTimeNanos", "eventTime", "time")
HOST_COLUMNS = ("hostId", "host", "hostname")
