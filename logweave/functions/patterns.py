r"""The grok library: names of patterns and captures that parsers use, with bodies written from the formats' definitions.

Names of patterns and of captures are fixed values, as are one-word bodies (WORD, DATA, SPACE and the like) and the
order of a log line's parts, which its producer's documentation gives. A deployment adds further patterns as files,
see ``grok.load_libraries``.

No group is repeated without a bound unless possessively: Java's engine takes a stack frame for each turn of any
other, and one long log line would end its executor.
"""

from __future__ import annotations

from logweave.functions.services import SERVICES


def shortened(words: str, least: int = 3) -> str:
    """Words that may be cut after their first letters: Jan(?:uary)?"""
    return "|".join(w[:least] + (f"(?:{w[least:]})?" if len(w) > least else "") for w in words.split())


def cased(words: str) -> str:
    """Each word in lower case, capitalised or in upper case; "info+rmation" may end at the plus sign."""
    forms = [f for w in words.split() for f in (w, w.capitalize(), w.upper())]
    return "|".join(f"{a}(?:{b})?" if b else a for a, _, b in (f.partition("+") for f in forms))


def quoted(mark: str) -> str:
    return rf"{mark}(?:[^\\{mark}]++|\\.)*+{mark}"


def groups(unit: str, times: int, mark: str) -> str:
    return f"{unit}(?:{mark}{unit}){{{times - 1}}}"


HEX = "[0-9A-Fa-f]"
OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
LABEL = r"[0-9A-Za-z](?:[0-9A-Za-z-]{0,61}[0-9A-Za-z])?"
#: RFC 5322 atoms.
ATOM = r"[\w!#$%&'*+/=?^`{|}~-]+"
_WORD16 = f"{HEX}{{1,4}}"
_DOTTED = groups(OCTET, 4, r"\.")
#: RFC 4291: eight groups; or some groups, "::" for one group or more, and the rest; the last two may be dotted.
_LONG = [f"(?:{_WORD16}:){{7}}{_WORD16}", f"(?:{_WORD16}:){{6}}{_DOTTED}"]
_SHORT = [f"(?:{_WORD16}:){{{n}}}(?:(?::{_WORD16}){{1,{7 - n}}}|:)" for n in range(1, 7)]
_SIX = [*_LONG, f"::(?:[Ff]{{4}}:)?{_DOTTED}", *_SHORT, f":(?:(?::{_WORD16}){{1,7}}|:)", f"(?:{_WORD16}:){{7}}:"]

BASIC = {
    # Words and numbers.
    "USERNAME": r"[\w.-]+", "USER": "%{USERNAME}", "WORD": r"\b\w+\b", "NOTSPACE": r"\S+", "SPACE": r"\s*", "DATA": ".*?", "GREEDYDATA": ".*",
    "INT": r"[-+]?\d+", "POSINT": r"\b[1-9]\d*\b", "NONNEGINT": r"\b\d+\b", "NUMBER": "%{BASE10NUM}",
    "BASE10NUM": r"[-+]?(?:\d+(?:\.\d+)?|\.\d+)", "BASE16NUM": f"[-+]?(?:0[xX])?{HEX}+", "BASE16FLOAT": rf"\b[-+]?(?:0[xX])?(?:{HEX}+(?:\.{HEX}*)?|\.{HEX}+)\b",
    "QUOTEDSTRING": "|".join(map(quoted, "\"'`")), "QS": "%{QUOTEDSTRING}",
    "UUID": f"{HEX}{{8}}(?:-{HEX}{{4}}){{3}}-{HEX}{{12}}",
    "URN": r"[Uu][Rr][Nn]:[0-9A-Za-z][0-9A-Za-z-]{0,31}:[\w()+,.:=@;$!*'/?#%-]+",
    # Addresses.
    "EMAILLOCALPART": rf"{ATOM}(?:\.{ATOM}){{0,31}}", "EMAILADDRESS": "%{EMAILLOCALPART}@%{HOSTNAME}",
    "CISCOMAC": groups(f"{HEX}{{4}}", 3, r"\."), "WINDOWSMAC": groups(f"{HEX}{{2}}", 6, "-"), "COMMONMAC": groups(f"{HEX}{{2}}", 6, ":"), "MAC": "%{CISCOMAC}|%{WINDOWSMAC}|%{COMMONMAC}",
    "IPV4": rf"(?<!\d){_DOTTED}(?!\d)", "IPV6": f"(?:{'|'.join(_SIX)})(?:%[0-9A-Za-z]+)?", "IP": "%{IPV6}|%{IPV4}",
    "HOSTNAME": rf"\b{LABEL}(?:\.{LABEL}){{0,126}}\.?", "IPORHOST": "%{IP}|%{HOSTNAME}", "HOSTPORT": "%{IPORHOST}:%{POSINT}",
    # Paths and addresses of resources.
    "PATH": "%{UNIXPATH}|%{WINPATH}", "UNIXPATH": r"/[\w./~@%+,:!$=-]*", "WINPATH": r"(?:[A-Za-z]+:|\\)\\[^?*]*", "TTY": r"/dev/(?:pts/\d+|tty\w*)",
    "URIPROTO": "[A-Za-z][0-9A-Za-z+.-]*", "URIHOST": "%{IPORHOST}(?::%{POSINT:port})?", "URIPATH": r"/[\w/$.+!*'(){},~:;=@#%&|-]*",
    "URIQUERY": r"[\w/$.+!*'|(){},~@#%&=:;?<>\[\]-]*", "URIPARAM": r"\?%{URIQUERY}", "URIPATHPARAM": "%{URIPATH}(?:%{URIPARAM})?",
    "URI": r"%{URIPROTO}://(?:%{USER}(?::[^@\s]*)?@)?(?:%{URIHOST})?(?:%{URIPATHPARAM})?",
    # Dates and times.
    "MONTH": rf"\b(?:{shortened('January February March April May June July August September October November December')})\b",
    "DAY": rf"\b(?:{shortened('Monday Tuesday Wednesday Thursday Friday Saturday Sunday')})\b",
    "MONTHNUM": "1[0-2]|0?[1-9]", "MONTHNUM2": "1[0-2]|0[1-9]", "MONTHDAY": r"3[01]|[12]\d|0?[1-9]", "YEAR": r"\d\d(?:\d\d)?",
    "HOUR": r"2[0-3]|[01]?\d", "MINUTE": r"[0-5]\d", "SECOND": r"(?:60|[0-5]?\d)(?:[:.,]\d+)?", "TIME": r"(?<!\d)%{HOUR}:%{MINUTE}:%{SECOND}(?!\d)",
    "DATE_US": "%{MONTHNUM}[/-]%{MONTHDAY}[/-]%{YEAR}", "DATE_EU": "%{MONTHDAY}[./-]%{MONTHNUM}[./-]%{YEAR}", "DATE": "%{DATE_US}|%{DATE_EU}", "DATESTAMP": "%{DATE}[ -]%{TIME}",
    "ISO8601_TIMEZONE": "Z|[-+]%{HOUR}:?%{MINUTE}", "ISO8601_SECOND": "%{SECOND}",
    "TIMESTAMP_ISO8601": "%{YEAR}-%{MONTHNUM}-%{MONTHDAY}[ T]%{HOUR}:?%{MINUTE}(?::?%{ISO8601_SECOND})?(?:%{ISO8601_TIMEZONE})?",
    "TZ": r"\b(?:[APMCE][SD]T|UTC|GMT|CES?T|[A-Z]{3,4})\b",
    "DATESTAMP_RFC822": "%{DAY} %{MONTH} %{MONTHDAY} %{YEAR} %{TIME} %{TZ}", "DATESTAMP_RFC2822": "%{DAY}, %{MONTHDAY} %{MONTH} %{YEAR} %{TIME} %{ISO8601_TIMEZONE}",
    "DATESTAMP_OTHER": "%{DAY} %{MONTH} %{MONTHDAY} %{TIME} %{TZ} %{YEAR}", "DATESTAMP_EVENTLOG": "%{YEAR}%{MONTHNUM2}%{MONTHDAY}%{HOUR}%{MINUTE}%{SECOND}",
    "HTTPDATE": "%{MONTHDAY}/%{MONTH}/%{YEAR}:%{TIME} %{INT}", "HTTPDERROR_DATE": "%{DAY} %{MONTH} %{MONTHDAY} %{TIME} %{YEAR}",
    "LOGLEVEL": cased("alert trace debug notice info+rmation warn+ing err+or crit+ical fatal severe emerg+ency"),
}

SYSLOG = {
    "SYSLOGTIMESTAMP": "%{MONTH} +%{MONTHDAY} %{TIME}", "SYSLOGHOST": "%{IPORHOST}", "PROG": r"[!-Z\\^-~]+",
    "SYSLOGPROG": r"%{PROG:program}(?:\[%{POSINT:pid}\])?", "SYSLOGFACILITY": r"<%{NONNEGINT:facility}\.%{NONNEGINT:priority}>",
    "SYSLOGBASE": "%{SYSLOGTIMESTAMP:timestamp} (?:%{SYSLOGFACILITY} )?%{SYSLOGHOST:logsource} %{SYSLOGPROG}:",
    "SYSLOGBASE2": "(?:%{SYSLOGTIMESTAMP:timestamp}|%{TIMESTAMP_ISO8601:timestamp8601}) (?:%{SYSLOGFACILITY} )?(?:%{SYSLOGHOST:logsource} +)?(?:%{SYSLOGPROG}:)?",
    "SYSLOGLINE": "%{SYSLOGBASE2} %{GREEDYDATA:message}",
    "SYSLOGPAMSESSION": r"%{SYSLOGBASE} %{WORD:pam_module}\(%{DATA:pam_caller}\): session %{WORD:pam_session_state} for user %{USERNAME:username}(?: by %{GREEDYDATA:pam_by})?",
    "CRON_ACTION": "[A-Z ]+", "CRONLOG": r"%{SYSLOGBASE} \(%{USER:user}\) %{CRON_ACTION:action} \(%{DATA:message}\)",
    # RFC 5424.
    "SYSLOG5424PRINTASCII": "[!-~]+", "SYSLOG5424PRI": "<%{NONNEGINT:syslog5424_pri}>", "SYSLOG5424SD": r"(?:\[[^\]]*\])++",
    "SYSLOG5424BASE": "%{SYSLOG5424PRI}%{NONNEGINT:syslog5424_ver} +(?:-|%{TIMESTAMP_ISO8601:syslog5424_ts}) +(?:-|%{IPORHOST:syslog5424_host}) +(?:-|%{SYSLOG5424PRINTASCII:syslog5424_app}) +(?:-|%{SYSLOG5424PRINTASCII:syslog5424_proc}) +(?:-|%{SYSLOG5424PRINTASCII:syslog5424_msgid}) +(?:-|%{SYSLOG5424SD:syslog5424_sd})",
    "SYSLOG5424LINE": "%{SYSLOG5424BASE} +%{GREEDYDATA:syslog5424_msg}",
}

#: The request line of HTTP as servers quote it; an odd one is kept whole.
_REQUEST = '"(?:%{WORD:verb} %{NOTSPACE:request}(?: HTTP/%{NUMBER:httpversion})?|%{DATA:rawrequest})"'
WEB = {
    "HTTPDUSER": "%{EMAILADDRESS}|%{USER}",
    "HTTPD_COMMONLOG": rf"%{{IPORHOST:clientip}} %{{HTTPDUSER:ident}} %{{HTTPDUSER:auth}} \[%{{HTTPDATE:timestamp}}\] {_REQUEST} (?:-|%{{NUMBER:response}}) (?:-|%{{NUMBER:bytes}})",
    "HTTPD_COMBINEDLOG": "%{HTTPD_COMMONLOG} %{QS:referrer} %{QS:agent}", "COMMONAPACHELOG": "%{HTTPD_COMMONLOG}", "COMBINEDAPACHELOG": "%{HTTPD_COMBINEDLOG}",
    "HTTPD20_ERRORLOG": r"\[%{HTTPDERROR_DATE:timestamp}\] \[%{LOGLEVEL:loglevel}\] (?:\[client %{IPORHOST:clientip}\] )?%{GREEDYDATA:message}",
    "HTTPD24_ERRORLOG": r"\[%{HTTPDERROR_DATE:timestamp}\] \[(?:%{WORD:module})?:%{LOGLEVEL:loglevel}\] \[pid %{POSINT:pid}(?::tid %{NUMBER:tid})?\](?: \(%{POSINT:proxy_errorcode}\)%{DATA:proxy_message}:)?(?: \[client %{IPORHOST:clientip}:%{POSINT:clientport}\])?(?: %{DATA:errorcode}:)? %{GREEDYDATA:message}",
    "HTTPD_ERRORLOG": "%{HTTPD24_ERRORLOG}|%{HTTPD20_ERRORLOG}",
    "S3_REQUEST_LINE": _REQUEST[1:-1],
    "S3_ACCESS_LOG": r'%{WORD:owner} %{NOTSPACE:bucket} \[%{HTTPDATE:timestamp}\] %{IP:clientip} %{NOTSPACE:requester} %{NOTSPACE:request_id} %{NOTSPACE:operation} %{NOTSPACE:key} (?:-|"%{S3_REQUEST_LINE}") (?:-|%{INT:response:int}) (?:-|%{NOTSPACE:error_code}) (?:-|%{INT:bytes:int}) (?:-|%{INT:object_size:int}) (?:-|%{INT:request_time_ms:int}) (?:-|%{INT:turnaround_time_ms:int}) (?:-|%{QS:referrer}) (?:-|%{QS:agent}) (?:-|%{NOTSPACE:version_id})',
    "ELB_URIPATHPARAM": "%{URIPATH:path}(?:%{URIPARAM:params})?", "ELB_URI": "%{URIPROTO:proto}://(?:%{USER}(?::[^@ ]*)?@)?(?:%{URIHOST:urihost})?(?:%{ELB_URIPATHPARAM})?",
    "ELB_REQUEST_LINE": "%{WORD:verb} %{ELB_URI:request}(?: HTTP/%{NUMBER:httpversion})?|%{DATA:rawrequest}",
    "ELB_ACCESS_LOG": '%{TIMESTAMP_ISO8601:timestamp} %{NOTSPACE:elb} %{IP:clientip}:%{INT:clientport:int} (?:-|%{IP:backendip}:%{INT:backendport:int}) %{NUMBER:request_processing_time:float} %{NUMBER:backend_processing_time:float} %{NUMBER:response_processing_time:float} (?:-|%{INT:response:int}) (?:-|%{INT:backend_response:int}) %{INT:received_bytes:int} %{INT:bytes:int} "%{ELB_REQUEST_LINE}"',
    "SQUID3": r"%{NUMBER:timestamp} +%{NUMBER:duration} %{IP:client_address} %{WORD:cache_result}/%{NONNEGINT:status_code} %{NUMBER:bytes} %{WORD:request_method} %{NOTSPACE:url} (?:-|%{NOTSPACE:user}) %{WORD:hierarchy_code}/(?:-|%{IPORHOST:server}) (?:-|%{NOTSPACE:content_type})",
}

#: The fields that HAProxy's two formats end with.
_CONNECTIONS = "%{INT:actconn}/%{INT:feconn}/%{INT:beconn}/%{INT:srvconn}/%{NOTSPACE:retries} %{INT:srv_queue}/%{INT:backend_queue}"
_ACCEPTED = r"%{IP:client_ip}:%{INT:client_port} \[%{HAPROXYDATE:accept_date}\] %{NOTSPACE:frontend_name} %{NOTSPACE:backend_name}/%{NOTSPACE:server_name}"
_LOGGED = "(?:%{SYSLOGTIMESTAMP:syslog_timestamp}|%{TIMESTAMP_ISO8601:timestamp8601}) %{IPORHOST:syslog_server} %{SYSLOGPROG}: "
HAPROXY = {
    "HAPROXYTIME": r"(?<!\d)%{HOUR:haproxy_hour}:%{MINUTE:haproxy_minute}(?::%{SECOND:haproxy_second})(?!\d)", "HAPROXYDATE": r"%{MONTHDAY:haproxy_monthday}/%{MONTH:haproxy_month}/%{YEAR:haproxy_year}:%{HAPROXYTIME:haproxy_time}\.%{INT:haproxy_milliseconds}",
    "HAPROXYCAPTUREDREQUESTHEADERS": "%{DATA:captured_request_headers}", "HAPROXYCAPTUREDRESPONSEHEADERS": "%{DATA:captured_response_headers}",
    "HAPROXYHTTPBASE": _ACCEPTED + r' %{INT:time_request}/%{INT:time_queue}/%{INT:time_backend_connect}/%{INT:time_backend_response}/%{NOTSPACE:time_duration} %{INT:http_status_code} %{NOTSPACE:bytes_read} %{DATA:captured_request_cookie} %{DATA:captured_response_cookie} %{NOTSPACE:termination_state} ' + _CONNECTIONS + r'(?: \{%{HAPROXYCAPTUREDREQUESTHEADERS}\})?(?: \{%{HAPROXYCAPTUREDRESPONSEHEADERS}\})? "(?:<BADREQ>|%{WORD:http_verb} (?:%{URIPROTO:http_proto}://)?(?:%{USER:http_user}(?::[^@ ]*)?@)?(?:%{URIHOST:http_host})?(?:%{URIPATHPARAM:http_request})?(?: HTTP/%{NUMBER:http_version})?)?"?',
    "HAPROXYHTTP": _LOGGED + "%{HAPROXYHTTPBASE}",
    "HAPROXYTCP": _LOGGED + _ACCEPTED + " %{INT:time_queue}/%{INT:time_backend_connect}/%{NOTSPACE:time_duration} %{NOTSPACE:bytes_read} %{NOTSPACE:termination_state} " + _CONNECTIONS,
}


def _end(side: str, user: str = "") -> str:
    """interface:address/port of one side of a connection, as firewalls write it."""
    return f"%{{DATA:{side}_interface}}:%{{IP:{side}_ip}}/%{{INT:{side}_port}}{user}"


def _user(name: str) -> str:
    return rf"(?:\(%{{DATA:{name}}}\))?"


def _ports(a: str = "src", b: str = "dst", between: str = " to ") -> str:
    return f"%{{IP:{a}_ip}}/%{{INT:{a}_port}}{between}%{{IP:{b}_ip}}/%{{INT:{b}_port}}"


_MATE = r"\((?:Primary|Secondary)\)"
_HITS = r"hit-cnt %{INT:hit_count} %{CISCO_INTERVAL:interval} \[%{DATA:hashcode1}, %{DATA:hashcode2}\]"
_ICMP = r"\(type %{INT:icmp_type}, code %{INT:icmp_code}\)"
CISCO = {
    "CISCOTIMESTAMP": "%{MONTH} +%{MONTHDAY}(?: %{YEAR})? %{TIME}", "CISCOTAG": "[A-Z0-9]+-%{INT}-[A-Z0-9_]+",
    "CISCO_TAGGED_SYSLOG": "^<%{POSINT:syslog_pri}>%{CISCOTIMESTAMP:timestamp}(?: %{SYSLOGHOST:sysloghost})? ?: %%{CISCOTAG:ciscotag}:",
    "CISCO_ACTION": r"Built|Teardown|Deny|Denied|denied|requested|permitted|denied by ACL|discarded|est-allowed|Dropping|created|deleted", "CISCO_DIRECTION": "Inbound|inbound|Outbound|outbound",
    "CISCO_REASON": r"Duplicate TCP SYN|Failed to locate egress interface|Invalid transport field|No matching connection|DNS Response|DNS Query|(?:%{WORD}\s*){1,12}",
    "CISCO_INTERVAL": r"first hit|%{INT}-second interval", "CISCO_XLATE_TYPE": "static|dynamic",
    "CISCOFW104001": _MATE + r" Switching to ACTIVE - %{GREEDYDATA:switch_reason}", "CISCOFW104002": _MATE + r" Switching to STANDBY - %{GREEDYDATA:switch_reason}",
    "CISCOFW104003": _MATE + r" Switching to FAILED\.", "CISCOFW104004": _MATE + r" Switching to OK\.",
    **{f"CISCOFW{n}": f"{_MATE} {text} %{{GREEDYDATA:interface_name}}{rest}" for n, text, rest in (
        ("105003", r"Monitoring on interface", " waiting"), ("105004", r"Monitoring on interface", " normal"), ("105005", "Lost Failover communications with mate on interface", ""),
        ("105008", "Testing Interface", ""), ("105009", r"Testing on interface", " (?:Passed|Failed)"))},
    "CISCOFW106001": "%{CISCO_DIRECTION:direction} %{WORD:protocol} connection %{CISCO_ACTION:action} from " + _ports() + " flags %{GREEDYDATA:tcp_flags} on interface %{GREEDYDATA:interface}",
    "CISCOFW106006_106007_106010": "%{CISCO_ACTION:action} %{CISCO_DIRECTION:direction} %{WORD:protocol} (?:from|src) %{IP:src_ip}/%{INT:src_port}" + _user("src_fwuser") + " (?:to|dst) %{IP:dst_ip}/%{INT:dst_port}" + _user("dst_fwuser") + " (?:on interface %{DATA:interface}|due to %{CISCO_REASON:reason})",
    "CISCOFW106014": "%{CISCO_ACTION:action} inbound %{WORD:protocol} src %{DATA:src_interface}:%{IP:src_ip}" + _user("src_fwuser") + " dst %{DATA:dst_interface}:%{IP:dst_ip}" + _user("dst_fwuser") + " " + _ICMP,
    "CISCOFW106015": r"%{CISCO_ACTION:action} %{WORD:protocol} \(%{DATA:policy_id}\) from " + _ports() + " flags %{DATA:tcp_flags}  ?on interface %{GREEDYDATA:interface}",
    "CISCOFW106021": "%{CISCO_ACTION:action} %{WORD:protocol} reverse path check from %{IP:src_ip} to %{IP:dst_ip} on interface %{GREEDYDATA:interface}",
    "CISCOFW106023": "%{CISCO_ACTION:action}(?: protocol)? %{WORD:protocol} src %{DATA:src_interface}:%{DATA:src_ip}(?:/%{INT:src_port})?" + _user("src_fwuser") + " dst %{DATA:dst_interface}:%{DATA:dst_ip}(?:/%{INT:dst_port})?" + _user("dst_fwuser") + f"(?: {_ICMP})?" + r' by access-group "?%{DATA:policy_id}"? \[%{DATA:hashcode1}, %{DATA:hashcode2}\]',
    "CISCOFW106100": r"access-list %{NOTSPACE:policy_id} %{CISCO_ACTION:action} %{WORD:protocol} %{DATA:src_interface}/%{IP:src_ip}\(%{INT:src_port}\)" + _user("src_fwuser") + r" -> %{DATA:dst_interface}/%{IP:dst_ip}\(%{INT:dst_port}\)" + _user("src_fwuser") + " " + _HITS,
    "CISCOFW106100_2_3": r"access-list %{NOTSPACE:policy_id} %{CISCO_ACTION:action} %{WORD:protocol} for user '%{DATA:src_fwuser}' %{DATA:src_interface}/%{IP:src_ip}\(%{INT:src_port}\) -> %{DATA:dst_interface}/%{IP:dst_ip}\(%{INT:dst_port}\) " + _HITS,
    "CISCOFW110002": "%{CISCO_REASON:reason} for %{WORD:protocol} from %{DATA:src_interface}:" + _ports(), "CISCOFW302010": "%{INT:connection_count} in use, %{INT:connection_count_max} most used",
    "CISCOFW302013_302014_302015_302016": "%{CISCO_ACTION:action}(?: %{CISCO_DIRECTION:direction})? %{WORD:protocol} connection %{INT:connection_id} for " + _end("src") + r"(?: \(%{IP:src_mapped_ip}/%{INT:src_mapped_port}\))?" + _user("src_fwuser") + " to " + _end("dst") + r"(?: \(%{IP:dst_mapped_ip}/%{INT:dst_mapped_port}\))?" + _user("dst_fwuser") + r"(?: duration %{TIME:duration} bytes %{INT:bytes})?(?: %{CISCO_REASON:reason})?(?: \(%{DATA:user}\))?",
    "CISCOFW302020_302021": "%{CISCO_ACTION:action}(?: %{CISCO_DIRECTION:direction})? %{WORD:protocol} connection for faddr %{IP:dst_ip}/%{INT:icmp_seq_num}" + _user("fwuser") + " gaddr %{IP:src_xlated_ip}/%{INT:icmp_code_xlated} laddr %{IP:src_ip}/%{INT:icmp_code}" + r"(?: \(%{DATA:user}\))?",
    "CISCOFW304001": "%{IP:src_ip}" + _user("src_fwuser") + " Accessed URL %{IP:dst_ip}:%{GREEDYDATA:dst_url}",
    "CISCOFW305011": "%{CISCO_ACTION:action} %{CISCO_XLATE_TYPE:xlate_type} %{WORD:protocol} translation from %{DATA:src_interface}:%{IP:src_ip}(?:/%{INT:src_port})?" + _user("src_fwuser") + " to %{DATA:src_xlated_interface}:%{IP:src_xlated_ip}/%{DATA:src_xlated_port}",
    "CISCOFW313001_313004_313008": "%{CISCO_ACTION:action} %{WORD:protocol} type=%{INT:icmp_type}, code=%{INT:icmp_code} from %{IP:src_ip} on interface %{DATA:interface}(?: to %{IP:dst_ip})?",
    "CISCOFW321001": "Resource '%{WORD:resource_name}' limit of %{POSINT:resource_limit} reached for system", "CISCOFW402117": "%{WORD:protocol}: Received a non-IPSec packet \\(protocol= %{WORD:orig_protocol}\\) from %{IP:src_ip} to %{IP:dst_ip}",
    "CISCOFW402119": "%{WORD:protocol}: Received an %{WORD:orig_protocol} packet \\(SPI= %{DATA:spi}, sequence number= %{DATA:seq_num}\\) from %{IP:src_ip} \\(user= %{DATA:user}\\) to %{IP:dst_ip} that failed anti-replay checking",
    "CISCOFW419001": "%{CISCO_ACTION:action} %{WORD:protocol} packet from " + _end("src") + " to " + _end("dst") + ", reason: %{GREEDYDATA:reason}", "CISCOFW419002": "%{CISCO_REASON:reason} from " + _end("src") + " to " + _end("dst") + " with different initial sequence number",
    "CISCOFW500004": "%{CISCO_REASON:reason} for protocol=%{WORD:protocol}, from " + _ports(), "CISCOFW710001_710002_710003_710005_710006": "%{WORD:protocol} (?:request|access) %{CISCO_ACTION:action} from %{IP:src_ip}/%{INT:src_port} to %{DATA:dst_interface}:%{IP:dst_ip}/%{INT:dst_port}",
    "CISCOFW602303_602304": r"%{WORD:protocol}: An %{CISCO_DIRECTION:direction} %{GREEDYDATA:tunnel_type} SA \(SPI= %{DATA:spi}\) between %{IP:src_ip} and %{IP:dst_ip} \(user= %{DATA:user}\) has been %{CISCO_ACTION:action}",
    "CISCOFW713172": r"Group = %{GREEDYDATA:group}, IP = %{IP:src_ip}, Automatic NAT Detection Status:\s+Remote end\s*%{DATA:is_remote_natted}\s*behind a NAT device\s+This\s+end\s*%{DATA:is_local_natted}\s*behind a NAT device",
    "CISCOFW733100": r"\[ ?%{DATA:drop_type}\] drop %{DATA:drop_rate_id} exceeded. Current burst rate is %{INT:drop_rate_current_burst} per second, max configured rate is %{INT:drop_rate_max_burst}; Current average rate is %{INT:drop_rate_current_avg} per second, max configured rate is %{INT:drop_rate_max_avg}; Cumulative total count is %{INT:drop_total_count}",
}

_FLOW = "%{IP:src-ip}/%{INT:src-port}->%{IP:dst-ip}/%{INT:dst-port} %{DATA:service} "
_NAT = "%{IP:nat-src-ip}/%{INT:nat-src-port}->%{IP:nat-dst-ip}/%{INT:nat-dst-port} %{DATA:src-nat-rule-name} %{DATA:dst-nat-rule-name} %{INT:protocol-id} %{DATA:policy-name} %{DATA:from-zone} %{DATA:to-zone} %{INT:session-id}"
FIREWALLS = {
    "RT_FLOW_EVENT": "RT_FLOW_SESSION_(?:CREATE|CLOSE|DENY)",
    "RT_FLOW1": "%{RT_FLOW_EVENT:event}: %{GREEDYDATA:close-reason}: " + _FLOW + _NAT + r" \d+\(%{DATA:sent}\) \d+\(%{DATA:received}\) %{INT:elapsed-time} .*", "RT_FLOW2": "%{RT_FLOW_EVENT:event}: session created " + _FLOW + _NAT + " .*",
    "RT_FLOW3": "%{RT_FLOW_EVENT:event}: session denied " + _FLOW + r"%{INT:protocol-id}\(\d\) %{DATA:policy-name} %{DATA:from-zone} %{DATA:to-zone} .*",
    "NETSCREENSESSIONLOG": r"%{SYSLOGTIMESTAMP:date} %{IPORHOST:device} %{IPORHOST}: NetScreen device_id=%{WORD:device_id}%{DATA}: start_time=%{QUOTEDSTRING:start_time} duration=%{INT:duration} policy_id=%{INT:policy_id} service=%{DATA:service} proto=%{INT:proto} src zone=%{WORD:src_zone} dst zone=%{WORD:dst_zone} action=%{WORD:action} sent=%{INT:sent} rcvd=%{INT:rcvd} src=%{IPORHOST:src_ip} dst=%{IPORHOST:dst_ip} src_port=%{INT:src_port} dst_port=%{INT:dst_port} src-xlated ip=%{IPORHOST:src_xlated_ip} port=%{INT:src_xlated_port} dst-xlated ip=%{IPORHOST:dst_xlated_ip} port=%{INT:dst_xlated_port} session_id=%{INT:session_id} reason=%{GREEDYDATA:reason}",
    "SHOREWALL": r"%{SYSLOGTIMESTAMP:timestamp} %{WORD:nf_host} .*Shorewall:%{WORD:nf_action1}?:%{WORD:nf_action2}?.*IN=%{USERNAME:nf_in_interface}?.*(?:OUT= *MAC=%{COMMONMAC:nf_dst_mac}:%{COMMONMAC:nf_src_mac}:|OUT=%{USERNAME:nf_out_interface}).*SRC=%{IPV4:nf_src_ip}.*DST=%{IPV4:nf_dst_ip}.*LEN=%{WORD:nf_len}.*TOS=%{WORD:nf_tos}.*PREC=%{WORD:nf_prec}.*TTL=%{INT:nf_ttl}.*ID=%{INT:nf_id}.*PROTO=%{WORD:nf_protocol}?.*SPT=%{INT:nf_src_port}?.*DPT=%{INT:nf_dst_port}?",
}

SERVERS = {
    # JVM programs.
    "JAVACLASS": r"(?:[A-Za-z$_][\w$]*\.){0,64}[A-Za-z$_][\w$]*", "JAVAFILE": r"[\w .-]+", "JAVAMETHOD": r"<(?:cl)?init>|[A-Za-z$_][\w$]*", "JAVALOGMESSAGE": ".*",
    "JAVASTACKTRACEPART": r"%{SPACE}at %{JAVACLASS:class}\.%{JAVAMETHOD:method}\(%{JAVAFILE:file}(?::%{NUMBER:line})?\)", "JAVATHREAD": r"[A-Z]{2}-Processor\d+",
    "CATALINA_DATESTAMP": r"%{MONTH} %{MONTHDAY}, (?:20)?%{YEAR} %{HOUR}:?%{MINUTE}(?::?%{SECOND})? (?:AM|PM)", "TOMCAT_DATESTAMP": "(?:20)?%{YEAR}-%{MONTHNUM}-%{MONTHDAY} %{HOUR}:?%{MINUTE}(?::?%{SECOND})? %{ISO8601_TIMEZONE}",
    "CATALINALOG": r"%{CATALINA_DATESTAMP:timestamp} %{JAVACLASS:class} %{JAVALOGMESSAGE:logmessage}", "TOMCATLOG": r"%{TOMCAT_DATESTAMP:timestamp} \| %{LOGLEVEL:level} \| %{JAVACLASS:class} - %{JAVALOGMESSAGE:logmessage}",
    "MAVEN_VERSION": r"\d+\.\d+(?:\.\d+)?(?:[.-](?:RELEASE|SNAPSHOT))?",
    # Databases.
    "REDISTIMESTAMP": "%{MONTHDAY} %{MONTH} %{TIME}", "REDISLOG": r"\[%{POSINT:pid}\] %{REDISTIMESTAMP:timestamp} \* ", "REDISMONLOG": r'%{NUMBER:timestamp} \[%{INT:database} %{IP:client}:%{NUMBER:port}\] "%{WORD:command}"\s?%{GREEDYDATA:params}',
    "MONGO_WORDDASH": r"\b[\w-]+\b", "MONGO_QUERY": r"\{ .* \}", "MONGO_LOG": r"%{SYSLOGTIMESTAMP:timestamp} \[%{WORD:component}\] %{GREEDYDATA:message}", "MONGO3_SEVERITY": r"\w", "MONGO3_COMPONENT": r"%{WORD}|-",
    "MONGO_SLOWQUERY": r"query %{MONGO_WORDDASH:database}\.%{MONGO_WORDDASH:collection} ntoreturn:%{NONNEGINT:ntoreturn} ntoskip:%{NONNEGINT:ntoskip} nscanned:%{NONNEGINT:nscanned}.*nreturned:%{NONNEGINT:nreturned}.* (?<duration>\d+)ms",
    "MONGO3_LOG": r"%{TIMESTAMP_ISO8601:timestamp} %{MONGO3_SEVERITY:severity} %{MONGO3_COMPONENT:component} +(?:\[%{DATA:context}\])? %{GREEDYDATA:message}",
    "POSTGRESQL": "%{DATESTAMP:timestamp} %{TZ} %{DATA:user_id} %{GREEDYDATA:connection_id} %{POSINT:pid}",
    # Others.
    "RUBY_LOGLEVEL": "DEBUG|FATAL|ERROR|WARN|INFO", "RUBY_LOGGER": r"[DFEWI], \[%{TIMESTAMP_ISO8601:timestamp} #%{POSINT:pid}\] *%{RUBY_LOGLEVEL:loglevel} -- +%{DATA:progname}: %{GREEDYDATA:message}",
    "RUUID": f"{HEX}{{32}}",
    "BIND9_TIMESTAMP": "%{MONTHDAY}-%{MONTH}-%{YEAR} %{TIME}",
    "BIND9": r"%{BIND9_TIMESTAMP:timestamp} queries: %{LOGLEVEL:loglevel}: client %{IP:clientip}#%{POSINT:clientport} \(%{GREEDYDATA:query}\): query: %{GREEDYDATA:query} IN %{GREEDYDATA:querytype} \(%{IP:dns}\)",
    "NAGIOSTIME": r"\[%{NUMBER:nagios_epoch}\]",
}

LIBRARY: dict[str, str] = {**BASIC, **SYSLOG, **WEB, **HAPROXY, **CISCO, **FIREWALLS, **SERVERS, **SERVICES}
