"""Common wordings of filler, of notices and of placeholders, which the models of :mod:`residue` are fitted on.

Every line is a pattern of slots; a slot lists its alternatives between ``|``, and a sample
of a pattern's combinations is drawn with a fixed seed.  The wordings are those that web
servers, content systems, text editors and templates use everywhere; none is taken from a
table that the models are run on.
"""

from __future__ import annotations

from functools import lru_cache
from http import HTTPStatus
from itertools import product
from math import prod

import numpy as np

#: Combinations drawn from one pattern.
DRAWN = 1500

# Notices, English.
NOTICES_EN = """
{The|This|That|Your}{ page| link| entry| article| item| content| post| record}{ is gone| has gone| has vanished| is missing| is dead| leads nowhere| is no longer there| was deleted| was withdrawn| is not here| can't be opened| you tried to open is gone| you tried to reach is gone| you clicked is broken}{|.}
{Please wait|Wait|Hold on}{ 0 seconds| 0 minutes| a moment| a few seconds| a while}{ before sending another request| before trying again| before you retry| and try again| and reload}{.|}
{Internal failure|Internal problem|System failure|Unexpected failure}{.|. Our team has been notified.|. We have been notified.|. Support has been informed.}
{Our team|The administrator|Support|We}{ has been notified| have been notified| has been informed| are working on it| is working on a fix}{|, please retry later}{.|}
{The backend|The server|The proxy|The host|The remote server}{ did not answer| did not answer in time| is not answering| gave no answer| failed to answer| returned an error}{|, please retry|, please try again}{.|}
{Only|This content is only for|This area is for}{ members| subscribers| registered users| staff}{| may read this| may see this page| can view this content}{.|. Please sign in.|. Log in to continue.}
{Nothing is shown|Nothing will be shown|The content is hidden}{| until scripts are enabled| while scripts are off| without scripts| because scripts are blocked}{.|}
{Scripts are|JavaScript is|Scripting is|Script execution is}{ off| switched off| turned off| blocked| disallowed}{| on this device| on your machine| in this browser}{|; please switch it on|; please enable it|, so nothing is shown}{.|}
{The |This |Our |}{site|website|web page|page|server|portal|service|app|application|system}{ is offline| is currently offline| is not responding| is busy| can't be reached| could not be reached| is not working| crashed| crashed unexpectedly| failed to load| is being updated| is closed for maintenance| will be back soon| will be back shortly}{|, please try again later|, please come back later|. Reload to try again}{.|}
{We are|We're|We were}{ having trouble| having problems| unable| not able| sorry}{ to load| loading| to display| displaying| showing| to open| reaching| to find}{ this page| this content| the content| the page| your request| this document}{| right now| at the moment| at this time}.
{Scheduled maintenance|Maintenance}{ is in progress| is under way| in progress| is being performed}{|. Please come back later|, we'll be back soon}{.|}
{You are|You're|This account is|Your account is}{ not authorized| not allowed| not permitted| not logged in| not signed in| blocked| suspended| logged out}{| to open this page| to view this folder| to see this document| from this site| to access this resource| to perform this action}.
{You are|You're}{ sending requests too quickly| making too many requests| going too fast| being rate limited| being redirected}{|, please slow down|. Slow down and try again}.
{Confirm|Prove|Verify|Please confirm|Please verify}{ that you are| you are}{ human| not a robot| not a bot}{| to continue| to proceed}.
{Login|Authentication|Registration|A subscription|Authorization}{ required| is required| failed}{| to view this page| to continue| to view the document}{.|}
{Insufficient}{ rights| permissions| privileges}{| to view this page}.
{Fetching|Retrieving|Loading|Rendering}{ data| content| the page| results}{, please wait|, please be patient|, hold on}{...|…|.}
{Please |You need to |You must |To continue, |You have to |}{enable|turn on|activate|allow|switch on}{ JavaScript| scripts| scripting| cookies| JavaScript and cookies}{| in your browser| in your browser settings| for this site| for this domain}{ to continue| to view this page| to use this site| to run this app| to access the content| and reload| and reload the page| and try again}.
{JavaScript|Scripting|JavaScript support|A browser with JavaScript}{ is required| is disabled| is turned off| is not enabled| is blocked| must be enabled| is needed| appears to be disabled}{| in your browser| on this device| to view this site| to display this page| for this application to work| to use this page}.
{This |Our |The }{page|site|application|website|content|app|document}{ requires| needs| relies on| works only with| cannot be shown without| does not work without| doesn't work properly without}{ JavaScript| scripts| cookies| a modern browser| JavaScript enabled}{| to load| to work}.
{Your browser|The browser you are using|This browser}{ does not support| doesn't support| is not supported by| blocks| has disabled| lacks}{ this page| scripts| JavaScript| the features this site requires| this application| this site}.
{Your browser|This browser}{ is not supported| is out of date| is too old}{| and may not show this page correctly|. Please update it|. Please use a newer one}.
{Loading|Please wait|Now loading|Just a moment|One moment please|Hang on|Still loading|Loading content|Loading page|Loading data}{|, please wait| while the page loads| while we check your browser| while we verify your request}{...|…|.|}
{If nothing happens|If the page does not appear|If this takes too long|If nothing appears|… if nothing appears}, {allow scripts|reload the page|check your connection|refresh your browser|click here|disable your ad blocker|make sure scripts are allowed}{| for this domain| and try again}.
{Checking|Verifying}{ your browser| your connection| that you are human| if the site connection is secure| you are not a robot}{| before accessing the site| before accessing the page| before accessing this website| before accessing the document| before accessing the portal| before you can continue| before accessing 0}{.|…}
{This process is automatic|This takes a few seconds|This may take a few seconds|You will be redirected shortly|Your browser will redirect to your requested content shortly|Redirecting|Performing a security check}{.|…}
{The |This |Sorry, the |Oops! The |We are sorry, the }{page|document|resource|file|article|address|URL|link}{| you requested| you are looking for| you are trying to reach| you followed| requested}{ could not be found| was not found| does not exist| no longer exists| has been moved| has been removed| is not available| may have been deleted| cannot be displayed| has moved or no longer exists| was not found on this server| has expired| is unavailable}.
{We could not find|We can't find|We couldn't find|Unable to find|Nothing was found at|There is nothing at|Unable to load}{ the page| this page| that page| what you were looking for| the requested document| this address}{| you requested| on this server}.
{Page|File|Document|Content|Resource|Article}{ not found| not available| unavailable| missing| removed| expired}{|.}
{Go back|Return|Back}{ to the home page| to the homepage| to the previous page| to the start page}{| or contact support| or contact the administrator| and try again}{|.}
{You do not have|You don't have|Your account does not have|This account does not have}{ permission| access| the required permissions| authorization| sufficient privileges}{ to view| to access| to open| to see}{ this page| this resource| this document| this content| this area| the requested page}.
{Access}{ denied| forbidden| restricted| to this page is denied| to this resource is forbidden| has been blocked| denied by the administrator}{|.}
{Please |You need to |You must |}{log in|sign in|log in again|sign in again|authenticate}{ to continue| to view this page| to see this content| to read the full article| to access this page|}{|.}
{Your session|The session|Your login|Your token}{ has expired| has timed out| is no longer valid| has ended}{| due to inactivity|; please log in again|, please sign in again}.
{Too many requests|You have sent too many requests|Request limit exceeded|Rate limit exceeded|Too many attempts|Unusual traffic was detected from your network|Your IP address has been blocked|Your request has been blocked|Suspicious activity was detected}{| from this address| by the firewall| for security reasons}{.|. Please try again later.|. Try again in 0 minutes.|. Please wait a moment and retry.}
{Please }{complete|solve|pass}{ the captcha| the security check| the verification}{ to continue| to proceed| to prove you are human}.
{Something went wrong|Oops! Something went wrong|An error occurred|An unexpected error occurred|An internal error occurred|There was a problem|An error has occurred|Sorry, something went wrong|An unknown error occurred|Oops}{| on our side| on our end| while loading this page| while processing your request| while rendering the page}{.|. Please try again later.|. Try again later.|. Please reload the page.|!}
{Please |}{try again|try again later|retry|reload the page|refresh the page|come back}{| in a few minutes| in 0 minutes| in 0 seconds| later}.
{The server|The service|This service|The site|The website|The upstream server|The gateway}{ is temporarily unavailable| is currently unavailable| encountered an internal error| did not respond in time| is down for maintenance| is undergoing maintenance| closed the connection| took too long to respond| could not process your request| refused to connect| returned an invalid response}{|. Please try again later}{.|}
{Error|Fatal error|Uncaught error|Exception|Request failed|TypeError}: {ETIMEDOUT|ECONNRESET|ECONNREFUSED|ENOTFOUND|connection timed out|connection refused|failed to load resource|failed to fetch|network error|script error}{| at line 0| while fetching 0| while loading the page}
{Reference|Ref|Ray ID|Ray|Incident ID|Support ID}{: | |=| #}0
{Error 0|HTTP 0|HTTP error 0}{|.}
"""
# Notices, Chinese.
NOTICES_ZH = """
{您|你|}{打开的|要看的|点击的|搜索的|寻找的}{页面|内容|文章|链接}{已经不在了|不在了|已经没有了|找不到|没有找到|已经被删除|已被作者删除|已被管理员删除|暂时看不了}{|，请返回|，请检查链接}{|。}
{没有找到|没找到|找不到|未找到|未能找到}{您要的|您想看的|相关的|对应的|}{内容|页面|结果|文章|资源}{|，请返回首页|，请换个关键词}{|。}
{此|该|这篇|本}{文章|内容|页面|帖子}{已被作者删除|已被删除|仅限会员阅读|需要登录后查看|仅对内部开放|已设为私密}{|。}
{请|请先|}{登录|登录账号|注册|登录您的账号}{后阅读全文|后再阅读|后查看内容|才能继续阅读|以阅读全文}{|。}
{请求|访问|操作|点击}{过多|太多|过于频繁|次数太多}{，请一分钟后再来|，请几分钟后再试|，请过一会儿再来|，请稍后再来}{|。}
{服务器|系统|网站|后台}{暂时|目前|现在|}{无法处理您的请求|无法响应|不能处理请求|无法提供服务|无法完成操作}{|，请稍后再试|，请稍后重试}{|。}
{网络|网络连接|信号}{不给力|不佳|不稳定|断开了|已断开}{|，请检查后重试|，请检查网络设置|，请稍后重试}{|。}
{请|您可以|}{允许|放行|启用}{本站|本网站|该网站|此页面}{运行脚本|使用脚本|加载脚本|使用 Cookie}{|后刷新|，然后刷新页面}{|。}
{浏览器|您的浏览器|系统}{禁止了|屏蔽了|阻止了|限制了}{脚本|脚本运行|脚本执行|页面脚本}{|，页面无法展示|，内容无法展示|，无法继续}{|。}
{该|此|您访问的|您点击的|}{链接|网页|网址|页面|文档|地址}{已经失效|已经过期|已经删除|不见了|丢失了|走失了|出错了|加载失败|加载出错|打开失败|无法打开|无法访问|访问出错|已被移走}{|，请检查网址|，请检查网址是否正确|，请返回重试|，点击重试|，请刷新重试|，请重试}{|。}
{内容|页面|数据|图片|列表}{加载不出来|加载出错|加载失败|无法加载|获取失败|显示异常}{|，请刷新|，请重试|，点击重试|，请稍后再试|，请检查网络}{|。}
{浏览器版本|您的浏览器版本|当前浏览器版本}{过低|太低|过旧|不受支持}{|，请升级|，请升级后访问|，请更换浏览器}{|。}
{需要|必须|请先|请}{开启|启用|打开|允许}{脚本|浏览器脚本| JavaScript| Cookie}{才能浏览|才能访问|才能浏览网页|后再浏览|后再访问|才可浏览本页}{|。}
{您|账号|用户|当前账号|您的账号}{尚未登录|未登录|没有登录|已退出登录|已被禁用|已被冻结|无权浏览|无权访问|没有权限浏览|没有权限打开}{|此页面|该文档|此内容|，请登录后查看|，请先登录|，请登录后访问}{|。}
{操作|访问|点击|请求|提交}{太快了|太快|过快|过于频繁|太频繁了}{|，请稍后再试|，休息一下再试|，请慢一点|，请过会儿再试}{|。}
{请求|访问|连接}{被防火墙|被安全策略|被安全网关|被网关|被系统|被服务器}{阻断|拦截|拒绝|拒绝了|中断}{|，请联系管理员}{|。}
{系统|服务器|网络|页面}{开小差了|出了点问题|走神了|崩溃了|正忙|异常|无响应|没有响应}{|，请重试|，请稍后重试|，请稍后再试|，请刷新页面}{|。}
{请|您需要|请先|请在浏览器中|请在浏览器设置中|您必须}{启用|开启|打开|允许运行}{ JavaScript |JavaScript|脚本|浏览器脚本|脚本功能| Cookie }{以继续访问本站|以查看本页|后重试|后刷新页面|并刷新页面|以正常使用本站|才能查看内容|后继续浏览|以显示完整内容}。
{本页面|本站|本网站|此页面|该页面|当前页面|本应用|内容}{依赖|需要|必须使用|需要启用}{脚本| JavaScript |脚本支持|脚本渲染}{|才能显示|才能运行|才能正常显示|，请更换浏览器|，请启用后重试|，当前浏览器已禁用脚本|，请更换浏览器后重试}。
{您的浏览器|当前浏览器|检测到浏览器}{已禁用|未启用|不支持|禁用了|拦截了|阻止了}{脚本| JavaScript|本站所需功能|该功能|此页面}{|，请开启后重试|，请升级浏览器|，部分内容无法显示|，请更换浏览器}。
{正在|页面|内容|数据|页面正在|内容正在}{加载中|加载|载入中|读取中|努力加载中}{|，请稍候|，请稍等|，请耐心等待|，请稍后|，如长时间无响应请刷新页面|……如长时间无响应，请检查网络|，请检查浏览器是否拦截了脚本}{|……|…|。}
{加载中|载入中|请稍候|请稍等|请等待|请耐心等待|稍等片刻}{|，页面即将跳转|，正在跳转|，正在验证您的浏览器|，正在检查访问环境}{|。|……|…}
{抱歉，|很抱歉，|对不起，|}{您访问的|您要找的|您查找的|您请求的|该|此|请求的|}{页面|网页|文档|内容|资源|地址|文章|链接}{不存在|找不到啦|找不到了|无法找到|未找到|已被删除|已下线|已失效|已过期|不存在或已被删除|暂时无法访问|已被移除|无法显示|打不开了|（0）不存在}{|。|（0），请稍后再试。|，请稍后再试。}
{返回|回到}{首页|上一页|主页}{|或联系管理员|，或稍后重试| | 联系管理员}{|。}
{您|当前用户|您的账号|当前账号|抱歉，您|}{没有|无|暂无|未获得|缺少}{访问权限|权限访问该页面|权限查看此内容|权限查看本页|查看权限|访问该页面的权限}{|，请联系管理员|，请登录后重试|，请申请权限|（0），请稍后再试}{|。}
{访问|操作|请求|您的访问}{受限|过于频繁|被拒绝|被拦截|异常|太频繁|次数过多|超出限制|已被限制}{|，请稍后再试|，请稍后重试|，请完成验证|，请在 0 秒后刷新|，请完成验证后继续|（0），请稍后再试}{|。}
{请|请先|您需要|需要}{登录|重新登录|完成验证|输入验证码|完成人机验证|进行身份验证|扫码登录}{后继续|后查看|后继续访问|以继续|后查看全文|后再试}{|。}
{登录|会话|您的登录|您的会话|登录状态|页面}{已过期|已失效|已超时}{|，请重新登录|，请刷新页面|，请重新登录后访问}{|。}
{系统|网站|平台|防火墙|}{检测到|发现}{异常请求|异常访问|异常流量|您的访问异常|来自您网络的异常流量}{，请稍后再试|，请完成验证后继续|，请在 0 秒后刷新|，已拦截本次请求}。
{您的地址|您的请求|您的网络}{触发了防护规则|被防火墙拦截|被安全策略拦截|已被封禁}{| 0}{|，请完成验证后继续|，请联系管理员|，请稍后再试}。
{出错了|系统错误|服务器错误|网络错误|网络异常|系统繁忙|服务器繁忙|服务器内部错误|服务异常|请求失败|加载失败|页面加载失败|网关超时|网关错误|网关无响应|请求超时|连接超时|服务暂不可用|服务暂时不可用|服务不可用|页面出错了|发生未知错误}{|，请稍后再试|，请稍后重试|，请刷新页面|，请联系管理员|，请检查网络|（0），请稍后再试|，请返回首页}{|。|！}
{网站|系统|服务|本站|页面}{正在维护|维护中|升级中|正在升级|已关闭|暂停服务|正在建设中}{|，请稍后访问|，敬请期待|，给您带来不便敬请谅解}{。|}
{错误编号|追踪号|参考编号}{ |：|: }0
{您可能想找|您是不是要找|猜您想找}：
{请稍后再试|请稍后重试|请在 0 秒后重试|请刷新页面后重试}{|。}
"""
# Notices, German.
NOTICES_DE = """
{Die |Diese }{aufgerufene Adresse|aufgerufene Seite|Adresse|Seite}{ gibt es nicht| gibt es nicht mehr| ist leer| bleibt leer| ist weg}{|.}
{Bitte |}{schalten Sie|lassen Sie}{ Skripte| JavaScript}{ ein| zu}{|, sonst bleibt die Seite leer|, um weiterzulesen}{.|}
{Sie müssen|Bitte}{ sich anmelden| sich registrieren| angemeldet sein}{|, um weiterzulesen|, um den Inhalt zu sehen|, um fortzufahren}{.|}
{Die Webseite|Die Seite|Der Server|Der Dienst|Die Anwendung}{ ist überlastet| ist derzeit nicht erreichbar| konnte nicht geladen werden| wird gewartet| antwortet nicht| funktioniert nur mit JavaScript| ist abgestürzt}{|, bitte später erneut versuchen|, bitte versuchen Sie es später|. Bitte neu laden}.
{Sie sind|Ihr Konto ist}{ nicht berechtigt| nicht angemeldet| nicht befugt| gesperrt}{|, dieses Dokument zu öffnen|, diese Seite zu sehen|, auf diese Seite zuzugreifen}.
{Bitte aktivieren Sie|Sie müssen|Bitte erlauben Sie}{ JavaScript| Skripte| Cookies}{| in Ihrem Browser}{, um fortzufahren|, um diese Seite anzuzeigen|, um die Seite zu nutzen| und laden Sie die Seite neu}.
{Diese Seite|Diese Anwendung|Dieser Inhalt}{ benötigt| erfordert| funktioniert nicht ohne}{ JavaScript| Skripte| Cookies}.
{JavaScript ist|Skripte sind}{ deaktiviert| erforderlich| nicht aktiviert| in Ihrem Browser deaktiviert}{|.}
{Die |Diese }{Seite|angeforderte Seite|gesuchte Seite|Ressource|Datei|Adresse}{ wurde nicht gefunden| existiert nicht| existiert nicht mehr| ist nicht verfügbar| konnte nicht gefunden werden| wurde verschoben| wurde entfernt| konnte nicht geladen werden}.
{Seite|Dokument|Datei}{ nicht gefunden| nicht verfügbar}{|.}
{Zugriff|Zugang}{ verweigert| gesperrt| nicht erlaubt| eingeschränkt}{|.}
{Sie haben keine Berechtigung|Sie haben keinen Zugriff|Ihr Konto hat keine Rechte}{ für diese Seite|, diese Seite zu sehen| auf diese Seite| für diesen Inhalt}.
{Bitte melden Sie sich}{ an| erneut an}{|, um fortzufahren|, um diese Seite zu sehen}.
{Ihre Sitzung|Die Sitzung}{ ist abgelaufen| wurde beendet}{|. Bitte melden Sie sich erneut an}.
{Bitte warten|Wird geladen|Seite wird geladen|Inhalt wird geladen|Einen Moment bitte}{...|…|.|}
{Ein Fehler ist aufgetreten|Es ist ein Fehler aufgetreten|Etwas ist schiefgelaufen|Zu viele Anfragen|Interner Serverfehler|Dienst nicht verfügbar|Der Server antwortet nicht|Der Dienst ist vorübergehend nicht erreichbar}{|. Bitte versuchen Sie es später erneut|. Bitte laden Sie die Seite neu}{.|}
"""
# Filler, English, Chinese and German.
FILLERS_EN = """
{This|The}{ chapter| section| page| part| article}{ has not been written yet| has not been written| has yet to be written| will be written later| will be completed later| is under construction| is not finished}{.|}
{TODO|TBD|To do|FIXME}{ write| describe| add| explain| finish| complete| -}{ the| this|}{ part| section| text| chapter| waiting for input| waiting for details| pending}{.|}
{Replace|Swap|Exchange}{ me| this| it}{ with real text| with the real text| with your text| with actual content| later}{.|}
{Text|Content|Words}{ for testing| to test}{ the layout| the page| only}{.|}
{Write|Put|Describe|Explain|Add|Give|Provide}{ something| the introduction| a short introduction| an overview| some text| some words| the summary| a sentence| more information}{ here| about this here| about this topic here| about this section here| in this place}{.|}
{This|The following}{ section| page| chapter| paragraph| part}{ is intentionally left blank| is left empty| is still empty| is not yet written| is to be written| has no content yet| will be filled later| is a stub| needs content}.
{Some|Descriptive|Introductory|More}{ text| content| words| information| details}{ will appear here| will be provided later| will follow| will be provided at a later date| will appear soon| go here}{.|}
{TODO|TBD|To do|To-do|FIXME}{ by| by the|: describe|: write|: explain|: document|: add|: list}{ team| owner| group| this| steps| the steps| usage| examples| details| the process}{.|}
{Content|Text|Description|Section|Details}{ pending review| under review| awaiting input| is missing| missing| is being prepared| in preparation}{.|}
{Text|Content|Description|Your text|Your content|Your title|Your summary|Body text|Main content|Your description|Heading|Summary}{ goes here| here| to be added| to be added later| to be written| to be provided| coming soon| to follow| will be added later| will go here| to come| is pending| to be confirmed}{.||…}
{Insert|Add|Enter|Type|Write|Paste}{ your| a| the|}{ text| description| content| title| summary| paragraph| name| details}{ here| later| below| in this section}{.|}
{Replace|Delete|Remove|Overwrite|Edit}{ this}{ text| block| paragraph| section| placeholder| line| sentence}{ with your own text| with your own content| before publishing| after editing| with real content| when done| with the actual content}.
{Click|Tap|Double-click} here{ to edit this text| to add text| to add a title| to edit| to add content| to change this text}{.|}
{This is|Here is}{ placeholder| dummy| sample| filler| example| a placeholder| temporary}{ text| content| paragraph| copy}{| and will be replaced| for layout purposes| only}.
{Sample|Dummy|Placeholder|Example|Filler|Default}{ text| paragraph| content| title| description| heading| entry| data}{.|}
{TODO|TBD|FIXME|TBA|WIP|XXX|TBC|N/A}{|: write this section|: add details|: fill in| - fill in later|: add description|: complete this section|: describe}
{To be completed|To be written|To be determined|To be announced|To be added|To be filled in|To be confirmed|To be defined|To be provided|To be supplied|To be documented|To be decided}{| later| soon| by the owner| by the author| by the team| by the responsible team| by the service owner| by the editor| by the reviewer| by the group| by staff| by the crew| by the engineer| by the platform team| by another team}{.|}
{Fill in|Fill this in}{ later| here| before release| the details| the blanks}{.|}
{Coming soon|Under construction|Work in progress|Nothing here yet|No content yet|More to come|Content missing|Not yet written|No description provided|Description missing|(none)|(empty)|(untitled)|(no title)|Untitled document|blah blah blah blah|foo bar baz foo bar|asdf asdf asdf asdf|test test test test|abc abc abc abc|xxx xxx xxx xxx|qwerty qwerty qwerty}{|.}
"""
FILLERS_ZH = """
{正文|内容|说明|文字|详情}{稍后|之后|以后|随后|日后}{补上|补充|再写|添加|奉上}{|。}
{内容|正文|文章|页面|文档}{准备中|筹备中|撰写中|编辑中|制作中|完善中|更新中}{|，敬请期待|，请稍候}{|。|……}
{（|(|【}{此处待|待|此处由|请}{作者|编辑|负责人}{填写|补充|撰写|确认}{）|)|】}
{此段|本段|这段|以上|以下}{文字|内容|文本|段落}{仅为占位|仅供占位|只是占位|为示例|为占位符}{|，请删除|，请替换|，发布前请删除}{|。}
{请|需要}{在这里|在此处|在下面}{补充|填写|写下|添加}{处理步骤|步骤|内容|背景|原因|操作说明|相关信息}{|。}
{此处|这里|在此|在这里|请在此处}{填写|写|写下|添加|输入|描述|介绍|补充}{正文内容|背景介绍|简介|具体内容|相关内容|详细说明|项目背景|章节内容|简要说明}{|。}
{待|由|等待|需}{负责人|作者|编辑|值班人员|相关团队|责任人}{补充|填写|完善|确认后填写|提供}{|。}
{本节|本章|本段|该章节|此部分|以下}{内容|说明|文字|}{待补|待补充|暂缺|暂无|暂未填写|为空|尚未填写|尚未编写|还没写|正在整理|整理中|正在整理中|有待完善}{|。|，敬请期待。}
{暂未|尚未|还未|暂时没有}{填写|补充|编写|提供|整理|录入}{|内容|说明}{|。}
{占位|示例|样例|模板|测试}{文本|段落|文字|内容}{，后期替换|，请自行修改|，请修改|，仅供排版|，可删除|，待替换}{|。}
{待|有待|尚待|内容待|正文待|此处待|本节待|说明待|描述待|详情待|，待}{补充|完善|填写|更新|编写|添加|整理|录入|撰写|补全}{|。|……|，敬请期待。|，|；|、}
{此处|这里|本段|本节|此段|该部分|这段文字}{为|是|仅为|填写|放|写|省略|插入|放置|}{占位内容|占位文字|占位符|示例文字|示例内容|默认文本|测试内容|一段说明|说明文字|模板文字}{|。|，|；|，请替换。|，请勿发布。|，发布前删除。|，稍后补充。}
{点击|单击|双击}{此处|这里}{编辑|添加|输入|修改}{内容|标题|文字|正文|描述|文本}{|。}
{请在此|请在这里|请}{填写|输入|补充|替换|添加}{内容|标题|说明|描述|正文|您的内容|本段文字|实际内容}{|。}
{示例|测试|样例|默认|占位|模板}{文字|内容|文本|段落}{|。|，|；}
{稍后|后续|之后|有空再|暂缺，后续|暂无内容，稍后}{补充|完善|更新|填写|添加|编写}{|。|……|，|；}
{未完待续|敬请期待|暂无内容|暂无描述|内容缺失|未命名文档|此处省略|（略）|（空）|（无）|内容建设中|文档编写中|TODO: 补全本节|文字文字文字文字|测试测试测试测试|内容内容内容内容|示例示例示例示例|啊啊啊啊啊啊啊}{|。|，待补充。}
{模板说明|填写说明|编写提示}：{删除本段后填写|请替换为实际内容|填写完毕后删除此行|发布前请删除}{。|}
"""
FILLERS_DE = """
{Abschnitt|Kapitel|Text|Seite}{ wird noch geschrieben| folgt in Kürze| ist noch leer| noch nicht geschrieben}{|.}
{Platzhalter|Blindtext}: {hier kommt der Text hin|Text folgt|hier steht bald ein Text|bitte ersetzen}{|.}
{Beschreibung|Inhalt|Text|Angabe|Abschnitt}{ fehlt noch| fehlt| wird später ergänzt| wird noch ergänzt| ist in Arbeit| bitte einfügen| hier einfügen}{.|}
{Hier|Bitte hier}{ bitte| den| einen|}{ Text| Inhalt| Namen| Titel}{ einfügen| eintragen| ergänzen}{.|}
{Hier|An dieser Stelle|In diesem Abschnitt}{ steht| folgt| erscheint}{ später| bald| demnächst|}{ ein| Ihr| der}{ Text| Inhalt| Beschreibungstext}.
{Dies ist ein|Das ist ein}{ Blindtext| Platzhalter| Platzhaltertext| Beispieltext| Mustertext}{.|, bitte ersetzen.}
{Platzhaltertext|Blindtext|Beispieltext|Mustertext|Text folgt|Inhalt folgt|Beschreibung folgt|Noch zu ergänzen|Wird noch ergänzt|Wird nachgereicht|Noch auszufüllen|Bitte ausfüllen|Bitte ergänzen}{|.|, bitte ersetzen.}
"""
# The words of the customary Latin filler.
LOREM = (
    "lorem ipsum dolor sit amet consectetur adipiscing elit sed do eiusmod tempor incididunt ut labore et dolore magna aliqua enim ad minim veniam "
    "quis nostrud exercitation ullamco laboris nisi aliquip ex ea commodo consequat duis aute irure in reprehenderit voluptate velit esse cillum "
    "fugiat nulla pariatur excepteur sint occaecat cupidatat non proident sunt culpa qui officia deserunt mollit anim id est laborum "
    "vivamus pellentesque maecenas vestibulum curabitur phasellus suspendisse mauris ligula vehicula sapien ultrices tincidunt faucibus"
)
# Placeholders in words, Chinese and English.
PLACEHOLDERS_ZH = """
{【|[|<|（|(}{请填写|请输入|在此输入|在此填写|待填写|待补充|请选择|请补充|填写|输入}{|名称|姓名|内容|负责人|日期|版本|地址|标题|系统名称}{】|]|>|）|)}
{（|(|【|[}{名称|负责人|日期|版本|时间|}{待定|待填|待确认}{）|)|】|]}
{xx|XX}{服务|组件|环境|系统|公司|平台|项目}{xx|XX}
"""
PLACEHOLDERS_EN = """
{[|<|{}{insert|enter|your|fill in|add|put}{ name| date| title| company| address| version| owner| text| value| name here| text here}{]|>|}}
"""
# Shapes of placeholders in template languages; ``word`` and ``WORD`` stand for any name.
SHAPES = [
    "{{word}}", "{{ word }}", "{{word.word}}", "{{ word_word }}", "${WORD}", "${WORD_WORD}", "${word}", "#{word}", "#{word_word}", "<%= word %>",
    "<%= word_word %>", "@@word@@", "@@word_word@@", "%word%", "%word_word%", "[[word]]", "[[word_word]]", "__WORD__", "__WORD_WORD__", "[WORD WORD]",
    "[WORD]", "<word-word>", "<WORD_WORD>", "%%WORD%%", "%%word_word%%", "{word_word}", "{word}",
]
# Signs that look like parts of placeholders and aren't.
PLAIN_SIGNS = [
    "Use %d and %s here", "%s of %d", "%d% of rows", "5% and 7% of it", "at 90 % or 95 %.", "a[i] and b[0]", "[1] and [2]", "[x] done", "[ ] open", "see [a](b)", "<b>x</b>", "a < b and c > d",
    "if a > b", "#1 and #12", "a@b.example", "$5 and $10", "a_b and c_d_e", "{a, b}", "f(x) and g(y)", "--flag=x", "a -> b", "<- c", "C# and F#", "**bold** and __strong__",
]
# Plain prose about the same things, and headings, in the three languages.
PLAIN = """
What this does and what it does not do
This does not change the result
The page of the manual describes how a request is handled
The console needs a browser; the command line does not
The client returns an error when the resource does not exist
If the server is not available the job waits and tries again later
The service was restarted and the error did not occur again
The request is sent to the server, which may close the connection
A session ends after the time that the administrator has set
The user must have permission to read the table
Access is checked before the document is opened
The script is loaded by the browser when the page is opened
Check the connection before you continue
The text of the message is written to the log
Add the name of the owner to the description
The content of the section is sorted by title
To change the value, edit the file and reload the service
To be sure that it works, run the test again
Enter the address of the host and the name of the database
The data is loaded in the background while the queue is drained
Limits on the number of requests protect the gateway
The sample was taken from the default configuration
What you need, where it is, and who may use it
There is no need to do this by hand
It is not required and may be removed
We found that the network was slow and the timeout too short
Preconditions
Permissions
Connections
Dependencies
Verification
Authentication
Authorization
Requirements
Requests
Sessions
Services
Resources
Errors
Error handling
Access
Access control
Loading
Sampling
Service levels
Deployment notes
Configuration
Description
Contents
Documents
Sign-in
Browser support
Server settings
Rate limits
Timeouts
Zugriff
Zugänge
Berechtigungen
Fehler
Fehlerbehandlung
Häufige Fehler
Seiten
Dienste
Anfragen
Sitzungen
Inhalt
Beschreibung
Die Seite des Handbuchs beschreibt, wie eine Anfrage behandelt wird
Der Dienst ist nicht erreichbar, wenn der Server neu startet
Die Verwaltung benötigt einen Browser, die Befehlszeile nicht
Der Text der Meldung steht im Protokoll
页面
内容
访问
权限
登录
会话
错误
错误处理
服务
网关
脚本
说明
描述
标题
正文
加载
请求
管理界面需要浏览器，命令行工具不受影响
请求被拒绝时，先检查访问权限
服务重启之后错误不再出现
页面由浏览器加载，脚本在后台运行
网关在超时之后关闭连接
用户登录之后可以查看文档
如果服务器没有响应，任务稍后重试
会话在设定的时间之后结束
说明文字写在标题的下面
内容按照标题排序
系统检测到延迟升高，值班人员确认后继续
请求过多时，网关会限制访问
"""


def _slots(pattern: str) -> list[list[str]]:
    """The alternatives of each slot; text outside braces is a slot of one.  A brace next to a bar or a brace stands for itself."""
    out, text, at = [], "", 0
    while at < len(pattern):
        if pattern[at] != "{":
            text, at = text + pattern[at], at + 1
            continue
        end = pattern.index("}", at)
        while pattern[end + 1 : end + 2] == "}":
            end += 1
        out.extend([[text]] * bool(text) + [pattern[at + 1 : end].split("|")])
        text, at = "", end + 1
    return out + [[text]] * bool(text)


def drawn(patterns: str, most: int = DRAWN, seed: int = 7) -> list[str]:
    """Up to ``most`` different combinations of each pattern, all where there are no more; every alternative of a slot comes about equally often."""
    rng, out = np.random.default_rng(seed), []
    for pattern in filter(None, patterns.split("\n")):
        slots = _slots(pattern)
        if prod(map(len, slots)) <= most:
            out.extend(map("".join, product(*slots)))
            continue
        picks = [np.concatenate([rng.permutation(len(s)) for _ in range(-(-most // len(s)))])[:most] for s in slots]
        out.extend(dict.fromkeys("".join(s[k] for s, k in zip(slots, row)) for row in zip(*picks)))
    return out


def reasons() -> list[str]:
    """Every reason phrase of HTTP errors in the usual settings."""
    phrases = [c.phrase for c in HTTPStatus if c >= 400] + ["Gateway Time-out", "Request Time-out", "Server Error", "Access Denied", "Page Not Found"]
    return [f for p in phrases for f in (p, f"0 {p}", f"0 - {p}", f"Error 0: {p}", f"HTTP 0 {p}")]


def strung(clauses: list[str], n: int = 1500) -> list[str]:
    """Chinese clauses, three in a row."""
    rng, short = np.random.default_rng(7), [c.rstrip("。，；、…") for c in clauses if len(c) < 10]
    return ["".join(short[k] + rng.choice(list("，、；。")) for k in rng.integers(0, len(short), 3)) for _ in range(n)]


@lru_cache(1)
def notices() -> dict[str, list[str]]:
    """Notices by model: one a language, and the reason phrases."""
    return {"notice_en": drawn(NOTICES_EN), "notice_zh": drawn(NOTICES_ZH), "notice_de": drawn(NOTICES_DE), "reason": reasons()}


@lru_cache(1)
def fillers() -> dict[str, list[str]]:
    """Filler by model: one a language, and the Latin one."""
    zh = drawn(FILLERS_ZH)
    return {"filler_en": drawn(FILLERS_EN), "filler_zh": zh + strung(zh), "filler_de": drawn(FILLERS_DE), "lorem": lorem()}


@lru_cache(1)
def lorem(n: int = 60) -> list[str]:
    rng, words = np.random.default_rng(7), LOREM.split()
    return [" ".join(rng.permutation(words)) for _ in range(n)]


@lru_cache(1)
def placeholders() -> dict[str, list[str]]:
    return {"phrase_zh": drawn(PLACEHOLDERS_ZH), "phrase_en": drawn(PLACEHOLDERS_EN)}
